from pathlib import Path

TABLES = Path("/root/testdata/sf0.001")


def table(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(rows.itertuples(index=False, name=None), key=repr)


def text_rows(spark, texts, extra=False):
    """Documents numbered from 0, with columns whose names operators use inside if ``extra``."""
    rows = [(i, t) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows],
                                 "doc_id long, text string, n long, lang_pred string, score double")

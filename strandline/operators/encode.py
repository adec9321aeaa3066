"""Fixed-length token encoding of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions.text import NOT_A_TOKEN

# The public protein token dictionary (special tokens, then residues).
PAD, UNK, CLS, SEP = 0, 1, 2, 3
RESIDUES = "LAGVESIKRDTPNQFYMHCWXUBZO"
FIRST_RESIDUE = 5


def residue_tokens(spark: SparkSession) -> DataFrame:
    """Token table ``(token, id)`` of the residue letters."""
    return spark.createDataFrame(
        [(r, FIRST_RESIDUE + i) for i, r in enumerate(RESIDUES)], "token string, id int")


def encode_tokens(
    df: DataFrame,
    sequence: str,
    tokens: DataFrame,
    max_len: int = 100,
    pad: int = PAD, unk: int = UNK, cls: int = CLS, sep: int = SEP,
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, both arrays of ``max_len`` ints.

    One token per character; characters that cannot be tokens are dropped first, then the
    text is cut to ``max_len - 2`` because a start and an end token are added. ``tokens``
    holds one row per character, so it is bounded by the alphabet. It reaches the tasks
    as one string and one array: a position in the string gives the index in the array.
    """
    packed = tokens.agg(F.sort_array(F.collect_list(F.struct("token", "id"))).alias("t")).select(
        F.struct(F.concat_ws("", F.col("t.token")).alias("chars"),
                 F.concat(F.array(F.lit(unk)), F.col("t.id")).alias("ids")))
    # The pattern walks to the last token that fits, wherever in the text that is, and stops.
    needed = F.regexp_extract(
        F.col(sequence), f"^(?>[{NOT_A_TOKEN}]*+[^{NOT_A_TOKEN}]){{0,{max_len - 2}}}+", 0)
    body = F.regexp_replace(needed, f"[{NOT_A_TOKEN}]+", "")
    filled = F.size("__c") + 2
    coded = F.transform("__c", lambda c: F.element_at(
        F.col("__tokens.ids"), F.instr(F.col("__tokens.chars"), c) + 1))
    return (
        df.withColumn("__tokens", packed.scalar())
        .withColumn("__c", F.filter(F.split(body, ""), lambda c: c != ""))
        .withColumn("input_ids", F.concat(
            F.array(F.lit(cls)), coded, F.array(F.lit(sep)),
            F.array_repeat(F.lit(pad), F.lit(max_len) - filled)))
        .withColumn("attention_mask", F.concat(
            F.array_repeat(F.lit(1), filled), F.array_repeat(F.lit(0), F.lit(max_len) - filled)))
        .drop("__tokens", "__c")
    )

"""Whole values behind every name."""

import functools
import math
import random
import time

from conftest_tables import text_rows
from strandline.llm import credentials

RANKS = {w: i for i, w in enumerate(credentials.WORDS, 1)}


def guesses(text, ranks=RANKS):
    return [text[a:b] for a, kind, b in credentials.scan_text(text, ranks) if kind == "guess"]


def test_values_with_symbols():
    for name in ("password", "PassWD", "secret", "token", "api_key", "apikey", "pwd", "mypassword", "credentials: password", "auth token"):
        for value in ("k#9Lw$2xQz", "$tR0ub4dor&3", "x7Kq9ZrT2m#%9"):
            for sign in (": ", "=", ' = "', "='", '": "'):
                found = guesses(f"a {name}{sign}{value}")
                assert len(found) == 1 and found[0].endswith(value), (name, sign, value)
    assert guesses("pwd=token=k#9Lw$2xQz") == ["token=k#9Lw$2xQz"]
    assert len(guesses("token=" * 20000)) <= 1    # in time that grows with the length
    assert guesses("password: sunshine#1") == []


def test_whole_values_are_masked(spark, shared):
    texts = ["password: k#9Lw$2xQz end", 'password = "$tR0ub4dor&3" é', "token=x7Kq9ZrT2m#%9, é", "password=sunshine#1 é", "é 😀 secret: abcdefgh&i"]
    rows = credentials.redact(credentials.scan(text_rows(spark, texts))).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["password: [SECRET] end", 'password = "[SECRET]" é', "[SECRET], é", "[SECRET] é", "é 😀 [SECRET]"]


def test_prose_is_no_secret(spark, shared):
    prose = ["the credentials provided by the office, credentials provided!", "a bearer certificate of deposit", "auth middleware runs",
             "secret: nothing is there", "the password protected archive", "token: nothing here", "api_key: *undefined*", "auth and/or, auth OAuth2"]
    known = ["nothing was undefined", "there is nothing", "an undefined word"]
    hidden = ["pwd: kxqzvwjab", "password: kxqzvwjab", "Authorization: Bearer x7Kq9ZrT2m", "auth k#Lwxzqprt"]
    rows = credentials.scan(text_rows(spark, prose + known + hidden)).orderBy("doc_id").collect()
    assert [r.spans for r in rows if "guess" in r.spans] == [r.spans for r in rows[-4:]]
    masked = credentials.redact(credentials.scan(text_rows(spark, prose + known))).orderBy("doc_id").collect()
    assert [r.text for r in masked] == prose + known


def test_corpus_words(spark, shared):
    texts = ["The table, the chair", "table! tabl3 chair été", "table té3 (chair)", "pwd: kxqzvwj", "pwd=kxqzvwj", "auth = 'kxqzvwj'", "a_table once", None]
    docs = text_rows(spark, texts)
    assert credentials.corpus_words(docs) == ["chair", "table"]
    assert credentials.corpus_words(docs, most=1) == [] and credentials.corpus_words(docs.limit(0)) == []


@functools.cache
def least_cost(value):
    """The least cost over all segmentations."""
    def part(a, b):
        text, size = value[a:b], b - a
        yield sum(math.log10(credentials._class_size(c)) for c in text)
        for plain, more in ((text.lower(), 0), (text.lower().translate(credentials.LEET), 1)):
            if 3 <= size <= credentials.LONGEST and plain in RANKS:
                yield math.log10(RANKS[plain] + 1) + (more + (text != text.lower())) * math.log10(2)
                break
        if credentials.DATE.fullmatch(text):
            yield credentials.DATE_COST[size > 4]
        for p in range(1, size // 2 + 1):
            if size >= 3 and all(text[i] == text[i - p] for i in range(p, size)):
                yield least_cost(text[:p]) + math.log10(size / p)
        keys = text.lower().translate(credentials.SHIFTED)
        if size >= 3 and all(credentials._walk(x, y) for x, y in zip(keys, keys[1:])):
            yield math.log10(94 * size) + 0.1 * size

    cost = [0.0]
    for b in range(1, len(value) + 1):
        cost.append(min(cost[a] + min(part(a, b)) + (credentials.GROUP_COST if a else 0) for a in range(b)))
    return cost[-1]


def test_least_cost():
    def cost(value):
        return credentials.guess_cost(value, RANKS)[0]

    assert cost("passworddddddd") < 5 > cost("abcabcabc") and cost("sunshine23456789") < credentials.STRONG
    assert cost("monkeymonkeymonkey") < 4
    rng = random.Random(5)
    parts = ["password", "qwerty", "love", "d", "dd", "eee", "234567", "poiu", "Kx9", "2019", "#", "ab1", "zq!", "Sun", "summer"]
    for _ in range(300):
        value = "".join(p * rng.choice((1, 1, 2, 3)) for p in rng.choices(parts, k=rng.randint(1, 4)))[:22]
        found, places = credentials.guess_cost(value, RANKS)
        assert abs(found - least_cost(value)) < 1e-9, value
        assert "".join(value[a:b] for _, a, b in places) == value
    start = time.process_time()
    assert cost("a1" * 50000) < 9 and cost("d" * 50000) < 9 and time.process_time() - start < 60

"""Secret scans: patterns, and a guess count for values that stand where credentials do.

The guess count of a value is that of the cheapest way to put it together from words, dates,
repeats, keyboard walks and stretches tried by brute force.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import schema_text, tidy
from strandline.plans.sizing import settle

# The base patterns and the least length of what they find (group 2 for assign).
# A run of access or hex characters always ends where it must, so its length can be part of the pattern.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ["assign", "access", "hex", "guess"]

# Names that a credential's value may follow, those of assign among them. The value's characters include symbols.
# A match is the name alone, with what lies before the value as group 1, so that a name which is a value itself counts too.
VALUE = r"[A-Za-z0-9+/_.=!@#$%^&*~-]"
CONTEXT = rf"""(?:(?:password|passwd|secret|token|api_?key)(?=(["']?(?:\x20*[:=]\x20*|\x20)["']?){VALUE})|(?<![A-Za-z])(?:pwd|passphrase|passcode|credentials?|auth|bearer|access_?key|private_?key)(?=(["']?(?:\x20*[:=]\x20*|\x20)["']?){VALUE}))"""

# Frequent parts of passwords, the most frequent first. A word's place is its cost.
WORDS = """
password qwerty dragon monkey letmein football baseball master shadow superman
welcome login admin user root test guest hello love secret
sunshine princess iloveyou trustno batman starwars freedom whatever flower summer
winter spring autumn monday friday january march april june july
august october december passw0rd pass word access changeme default system
server public private token example sample demo temp temporary internal
company office manager support service account database oracle mysql postgres
samsung google apple amazon microsoft windows linux ubuntu android computer
internet killer pepper ginger cookie banana orange purple yellow silver
golden diamond tiger lion eagle falcon hunter ranger soccer hockey
michael jordan charlie thomas robert daniel andrew joshua jessica ashley
jennifer nicole amanda maggie buster harley mustang ferrari corvette mercedes
please required value string none null true false your here
""".split()

# Rows of the usual keyboard, for walks along them.
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
LEET = str.maketrans("4@3105$7", "aaeiosst")

# At most so many words of a corpus, of at most LONGEST letters each: under a megabyte.
CORPUS_WORDS = 32768
GROUP_COST = math.log10(20)
STRONG = 9.0
LONGEST = 24


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near[key] = {ROWS[y][x] for y, x in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1),
                                                 (r + 1, c - 1), (r + 1, c))
                         if 0 <= y < len(ROWS) and 0 <= x < len(ROWS[y])}
    return near


NEAR = _neighbours()
DATE = re.compile(r"(?:(19|20)\d\d[-/._]?(0[1-9]|1[0-2])[-/._]?(0[1-9]|[12]\d|3[01])"
                  r"|(0[1-9]|[12]\d|3[01])[-/._]?(0[1-9]|1[0-2])[-/._]?(19|20)\d\d"
                  r"|(19|20)\d\d)")
DATE_COST = {True: math.log10(366 * 120), False: math.log10(120)}


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33


def _walk(a: str, b: str) -> bool:
    """Whether the second key is beside the first, or the same step along the alphabet or digits."""
    return b in NEAR.get(a, ()) or (a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1)


def guess_cost(value: str, words: dict[str, int], blocks: dict[str, float] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for ``value``, and its cheapest segmentation (kind, start, end).

    ``cost[j]`` is the least cost of the first j characters. Every part beside the first costs
    a factor of 20 more, for guessing where it starts. Words, dates and blocks that repeat have at most ``LONGEST`` characters.
    A repeat or a walk may be of any length and start anywhere in its run. Its cost grows with the logarithm
    of its length, so a start that an earlier one equals never wins again; few starts are kept, and
    the work grows in proportion to the length.
    """
    size = len(value)
    plain = value.lower()
    leet, keys = plain.translate(LEET), plain.translate(SHIFTED)
    same = [0] * (LONGEST + 1)    # how long characters have been those one period before
    runs: dict[int, list[tuple[int, float]]] = {}    # starts of repeats by period, of walks under 0, and their costs
    walk = 1
    tried, tried_from = math.inf, 0    # least cost with a brute-force part at the end, and where that starts
    blocks = {} if blocks is None else blocks    # costs of blocks that repeat
    cost = [0.0] + [math.inf] * size
    back: list[tuple[str, int]] = [("", 0)] * (size + 1)
    dates: dict[int, list[int]] = {}
    for start in range(size):
        if found := DATE.match(value, start):
            dates.setdefault(found.end(), []).append(start)

    def offer(kind: str, start: int, end: int, parts: float) -> None:
        total = cost[start] + parts + (GROUP_COST if start else 0.0)
        if total < cost[end]:
            cost[end], back[end] = total, (kind, start)

    def run(name: int, kind: str, start: int, end: int, parts: float, unit: int, more: float = 0.0) -> None:
        """Offer the best start of a run, with ``start`` as a new one."""
        kept, least = [], math.inf
        for at, fixed in [*runs.get(name, ()), (start, cost[start] + parts + (GROUP_COST if start else 0.0))]:
            total = fixed + math.log10((end - at) / unit)
            if total < least:
                kept.append((at, fixed))
                least = total
        runs[name] = kept
        if least + more < cost[end]:
            cost[end], back[end] = least + more, (kind, kept[-1][0])

    for end in range(1, size + 1):
        # Brute force goes on from a brute-force part or starts one.
        each = math.log10(_class_size(value[end - 1]))
        fresh = cost[end - 1] + (GROUP_COST if end > 1 else 0.0)
        if fresh < tried:
            tried, tried_from = fresh, end - 1
        tried += each
        cost[end], back[end] = tried, ("brute", tried_from)
        for length in range(3, min(LONGEST, end) + 1):
            part = plain[end - length:end]
            rank = words.get(part)
            other = rank is None
            if other:
                rank = words.get(leet[end - length:end])
            if rank is not None:
                cased = value[end - length:end] != part
                offer("word", end - length, end, math.log10(rank + 1) + (cased + other) * math.log10(2))
        for start in dates.get(end, ()):
            offer("date", start, end, DATE_COST[end - start > 4])
        last = end - 1
        for period in range(1, min(LONGEST, last) + 1):
            if value[last] != value[last - period]:
                same[period] = 0
                runs.pop(period, None)
                continue
            same[period] += 1
            shortest = max(3, 2 * period)
            if same[period] >= shortest - period:
                start = end - shortest
                block = value[start:start + period]
                if block not in blocks:
                    blocks[block] = guess_cost(block, words, blocks)[0]
                run(period, "repeat", start, end, blocks[block], period)
        walk = walk + 1 if last and _walk(keys[last - 1], keys[last]) else 1
        if walk == 1:
            runs.pop(0, None)
        if walk >= 3:
            run(0, "walk", end - 3, end, math.log10(94) - 0.1 * (end - 3), 1, 0.1 * end)
    parts, end = [], size
    while end:
        kind, start = back[end]
        parts.append((kind, start, end))
        end = start
    return cost[size], parts[::-1]


def corpus_words(docs: DataFrame, text: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """Words of 3 to ``LONGEST`` ASCII letters that stand in most documents, at least two, the most frequent first.

    Values behind names of credentials are left out, so that a password that comes often is no word by that.
    At most ``most`` words come to the driver; of equally frequent ones at the end all or none.
    """
    value = rf"(?i){CONTEXT}\1?\2?{VALUE}+"
    prose = F.regexp_replace(text, value, " ")
    word = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])[a-z]{{3,{LONGEST}}}(?![\p{{L}}\p{{M}}\p{{N}}_])"
    counts = settle(docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(prose), F.lit(word), F.lit(0)))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Documents of n words have at most sqrt(2 n) different counts.
    least, room = None, most
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        room -= row.words
        if room < 0:
            break
        least = row.n
    if least is None:
        return []
    return [r.word for r in sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))]


def _mixed(value: str) -> bool:
    """Whether a value has two of small letters, capitals inside, digits and symbols inside, as prose rarely has."""
    inner = value.strip("!@#$%^&*~_.=/+-")
    return sum(bool(re.search(c, inner)) for c in ("[a-z]", "(?<=.)[A-Z]", "[0-9]", "[!@#$%^&*]")) > 1


def _values(text: str):
    """Places of the values behind names; a value inside another has the same end.

    Behind a mere space only values of mixed characters are meant.
    """
    end = 0
    for m in re.finditer(CONTEXT, text, re.IGNORECASE | re.ASCII):
        start = m.end(m.lastindex)
        if start >= end:
            end = re.compile(f"{VALUE}+").match(text, start).end()
        if m[m.lastindex].strip("\"' ") or _mixed(text[start:end]):
            yield start, end


def scan_text(text: str, words: dict[str, int], strong: float = STRONG) -> list[tuple[int, str, int]]:
    """Spans (start, kind, end) in code points, by start and then by the order of the kinds."""
    spans, done = [], 0
    if "=" in text or ":" in text:
        for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                spans.append((m.start(), "assign", m.end()))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text)]
    for start, end in _values(text):
        # A value inside another is scored with it.
        if end > done:
            done = end
            if guess_cost(text[start:end], words)[0] >= strong:
                spans.append((start, "guess", end))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, text: str = "text", words: list[str] | None = None,
         strong: float = STRONG) -> DataFrame:
    """Add counts and places of secrets to every row of ``docs``.

    ``n_assign``, ``n_access`` and ``n_hex`` count the base patterns, ``base_sha256`` is the hash
    of their places, ``spans`` lists all places as kind:start:end, joined by commas. Kind ``guess`` marks
    values after a credential's name that take 10^``strong`` guesses or more; symbols (``VALUE``) are part of them. A null text is
    empty. Behind a name there must be a colon or an equals sign, or a value of mixed characters. ``words`` is
    the ranked word list of the guess count; if None, it is ``WORDS`` and behind them ``corpus_words(docs)``. Columns of these names in ``docs`` are replaced; repeated rows are scanned each.
    """
    if words is None:
        words = WORDS + corpus_words(docs, text)
    ranks = {w: r for r, w in reversed(list(enumerate(words, 1)))}
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kept = docs.drop(*added)
    number = kept.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(number):
                spans = scan_text(value.as_py() or "", ranks, strong)
                base = [s for s in spans if s[1] != "guess"]
                counts = [sum(s[1] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns[:3]),
                 *(pa.array(c, pa.string()) for c in columns[3:])], [*batch.schema.names, *added])

    return kept.mapInArrow(lambda batches: tidy(run(batches)), f"{schema_text(kept)}, n_assign long, n_access long, n_hex long, "
                           "base_sha256 string, spans string")


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span that ``scan`` found by ``mask``; overlapping ones by a single one.

    A value that an assign span ends inside of is replaced to its end. Only rows with spans change. Works on JVM expressions, from the last span to the first.
    """
    def end(s):
        return F.split_part(s, F.lit(":"), F.lit(3)).cast("int")

    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"),
        (end(s) + F.when(s.startswith("assign"), F.length(F.regexp_extract(
            F.substr(F.col(text), end(s) + 1, F.length(text)), f"^{VALUE}*", 0))).otherwise(0)).alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(F.array_sort(parts), start, lambda acc, s: F.when(
        s["a"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, s["a"] - acc["at"]),
                          F.lit(mask)).alias("out"), s["b"].alias("at"))).otherwise(
        F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["b"]).alias("at"))))
    changed = F.concat(folded["out"], F.substr(F.col(text), folded["at"] + 1, F.length(text)))
    return scanned.withColumn(text, F.when(F.col("spans") != "", changed).otherwise(F.col(text)))

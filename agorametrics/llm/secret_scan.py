"""Secret scans: patterns of known forms, and values in credential contexts by their guess cost.

Base spans are the matches of three patterns: an assignment to a credential's name, access keys, and long
runs of hexadecimal digits. The method looks at further contexts (other names, ``is``, bearer tokens,
passwords in URLs, values with any sign in them) and asks how many guesses a value would cost: the cheapest
way to cut it into words, dates, repeats, keyboard walks and spans of single characters, found by dynamic
programming over its positions. A value of ``STRONG`` bits or more that lies in no base span is a span of
kind ``guess``. Costs add up in bits, and every segment pays for its kind.

Words are runs of letters between other signs, counted over all texts of the corpus, but for values
assigned to a credential's name; a word costs the logarithm of how many words are at least as frequent. Words
have ``SHORTEST`` to ``LONGEST`` letters, which also bounds the substrings a value is looked up by. Spark
counts words and joins them with the substrings of distinct values; neither is ever collected.

Null and empty texts have no spans. Repeated rows each keep theirs; ids may be null. Texts and values are
read whole, however long. Spans are code points, ends exclusive; equal starts are ordered by kind as in
``KINDS``. An empty table gives no rows. Columns other than id and text are left aside.
"""

from __future__ import annotations

import math
import re
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import LOWER, WORD, lists, packed, pieces, raw, spans, stored

KINDS = ["assign", "access", "hex", "guess"]

# Fixed patterns of the base: kind, what it looks like, group whose length counts, fewest characters.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]

# Where values are asked for their guess cost: a credential's name and a sign, ``is`` or ``bearer``; userinfo of a URL.
NAMED = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret|signing|encryption)[_-]?key|credentials?|authorization)"""
    r"""["'\]]{0,2}(?:\x20*(?P<sign>=>|:=|[:=])\x20*(?:bearer\x20+|basic\x20+)?|\x20+is\x20+)["'`]?(?P<value>[^\s"'`<>]{6,})""", re.IGNORECASE | re.ASCII)
BEARER = re.compile(r"""\bbearer\x20+(?P<value>[^\s"'`<>]{6,})""", re.IGNORECASE | re.ASCII)
USERINFO = re.compile(r"""://[^\s/:@]*:(?P<sign>)(?P<value>[^\s/@]{6,})@""")
CONTEXTS = [NAMED, BEARER, USERINFO]
# What Arrow tests a text for, before it is searched: every match holds a match of this.
HINT = r"(?i)passw|passphrase|passcode|pwd|secret|token|key|credential|authorization|bearer|://[^\s]*@|AKIA|[0-9a-f]{24}"

STRONG = math.log2(1e10)
SHORTEST, LONGEST = 3, 24

# Keys of a keyboard, row by row, each row shifted to the right by half a key; and the same with shift.
ROWS = ["`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./"]
SHIFTED = ["~!@#$%^&*()_+", "\tQWERTYUIOP{}|", '\tASDFGHJKL:"', "\tZXCVBNM<>?"]
PLACE = {c: (y, x) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "\t"}
STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}

# Signs written for letters.
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"})

KIND = math.log2(5)  # which kind a segment is
START, TURN, ONWARD = math.log2(47), math.log2(6) + 1, 1.0  # a walk's first key, a step in another or the same direction
NEAR = 2000  # dates cost the more the farther from this year
DATES = [
    (re.compile(r"(?=((?P<y>\d{4})(?P<s>[-/._ ]?)(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})))"), 0),
    (re.compile(r"(?=((?P<d>\d{1,2})(?P<s>[-/._ ]?)(?P<m>\d{1,2})(?P=s)(?P<y>\d{4})))"), 0),
    (re.compile(r"(?=((?P<m>\d{1,2})(?P<s>[-/._ ]?)(?P<d>\d{1,2})(?P=s)(?P<y>\d{4})))"), 0),
    (re.compile(r"(?=((?P<y>(?:19|20)\d\d)))"), 1),
]


def character(c: str) -> float:
    """Bits of one character nothing is known of: one of its class."""
    if c >= "\x80":
        return 7.0
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def lowered(value: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def substrings(value: str) -> set[str]:
    """What a value may hold of the words: runs of letters in it, as they stand and with signs read as letters."""
    out = set()
    low = lowered(value)
    for form in {low, low.translate(LEET)}:
        for run in re.finditer(r"[^\W\d_]+", form):
            text = run.group()
            out.update(text[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(text) - n + 1))
    return out


def word_bits(part: str, known: dict[str, float]) -> float | None:
    """Bits of a part of a value that is a word: its rank, how its letters are written, which are signs."""
    low = lowered(part)
    best = None
    for form in (low, low.translate(LEET)):
        if form in known:
            upper = sum(c.isupper() for c in part)
            plain = part[1:] == low[1:] or upper == len(part)
            cost = known[form] + (0 if not upper else 1 if plain else math.log2(math.comb(len(part), upper)) + 1)
            cost += 2.0 * sum(a != b for a, b in zip(low, form, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def dates(value: str) -> dict[tuple[int, int], float]:
    """Bits of every part that is a date or a year."""
    out: dict[tuple[int, int], float] = {}
    for pattern, year_only in DATES:
        for m in pattern.finditer(value):
            year = int(m["y"])
            cost = math.log2(max(abs(year - NEAR), 20))
            if not year_only:
                try:
                    date(year, int(m["m"]), int(m["d"]))
                except ValueError:
                    continue
                cost += math.log2(365) + (2 if m["s"] else 0)
            out[m.span(1)] = min(cost, out.get(m.span(1), math.inf))
    return out


def walks(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to the next one, None where they are no neighbours."""
    if a not in PLACE or b not in PLACE:
        return None
    step = (PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1])
    return step if step in STEPS else None


def repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By start: length of a unit of up to ``LONGEST`` characters and how often it comes, as often as it does, twice and for
    three characters at least. A repeat starts less than a unit after its run does."""
    out: dict[int, list[tuple[int, int]]] = {}
    if len(value) < 3:
        return out
    codes = np.array([ord(c) for c in value])
    for unit in range(1, min(LONGEST, len(value) // 2) + 1):
        # runs of places that are equal to the one a unit further
        same = np.concatenate([[False], codes[:-unit] == codes[unit:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for i in range(start, min(start + unit, stop - unit + 1)):
                times = (stop - i) // unit + 1
                if unit * times >= 3:
                    out.setdefault(i, []).append((unit, times))
    return out


def guess_bits(value: str, known: dict[str, float]) -> tuple[float, list[tuple[int, int, str]]]:
    """The cheapest cost of a value in bits, and its segments: start, end, kind. ``known``: bits of the words it may hold."""
    return _cheapest(value, known, {})


def _cheapest(value: str, known: dict[str, float], units: dict[str, float]) -> tuple[float, list[tuple[int, int, str]]]:
    n, low = len(value), lowered(value)
    leet = low.translate(LEET)
    # (cost, start, kind) of the cheapest end at each position, of any kind, in a span of characters, in a walk
    best = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    brute = walk = (math.inf, 0)
    direction = None
    ahead: dict[int, list[tuple[float, int, str]]] = {}
    for (i, j), cost in dates(value).items():
        ahead.setdefault(i, []).append((cost, j, "date"))
    for i, found in repeats(value).items():
        for unit, times in found:
            part = value[i:i + unit]
            if part not in units:
                units[part] = _cheapest(part, known, units)[0]
            ahead.setdefault(i, []).append((units[part] + math.log2(times), i + unit * times, "repeat"))
    for i in range(n):
        for cost, j, kind in ahead.get(i, ()):
            best[j] = min(best[j], (best[i][0] + KIND + cost, i, kind))
        for j in range(i + SHORTEST, min(i + LONGEST, n) + 1) if known else ():
            if low[i:j] in known or leet[i:j] in known:
                best[j] = min(best[j], (best[i][0] + KIND + word_bits(value[i:j], known), i, "word"))
        brute = min(brute, (best[i][0] + KIND, i))
        brute = (brute[0] + character(value[i]), brute[1])
        step = walks(value[i - 1], value[i]) if i else None
        if step is None:
            walk = (math.inf, 0)
        else:
            onward = walk[0] + (ONWARD if step == direction else TURN)
            walk = min((onward, walk[1]), (best[i - 1][0] + KIND + START + TURN, i - 1))
        direction = step
        best[i + 1] = min(best[i + 1], (*brute, "characters"), (*walk, "walk"))
    segments, at = [], n
    while at:
        _, start, kind = best[at]
        segments.append((start, at, kind))
        at = start
    return best[n][0], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and number of kind of the base's matches."""
    out = []
    for k, (_, pattern, group, fewest) in enumerate(BASE):
        out += [(*m.span(), k) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= fewest]
    return sorted(out, key=lambda s: (s[0], s[2]))


def context_values(text: str) -> list[tuple[int, int, bool]]:
    """Start, end of the values in credential contexts, and whether a sign assigns them; closing punctuation is none of them."""
    out: dict[tuple[int, int], bool] = {}
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            value = m["value"].rstrip(".,:;!?)]}")
            if len(value) >= 6:
                span = m.start("value"), m.start("value") + len(value)
                out[span] = out.get(span, False) or m.groupdict().get("sign") is not None
    return [(*span, assigned) for span, assigned in sorted(out.items())]


def hinted(column: pa.Array) -> np.ndarray:
    """Rows whose text can hold a match at all."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, HINT), False).to_numpy(zero_copy_only=False))


FOUND = "doc_id long, base array<struct<start: int, stop: int, kind: int>>, others array<struct<start: int, stop: int, value: string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32())]))
_VALUE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base spans of every text, and the values in credential contexts that lie in none of them."""

    def run(batches):
        for batch in pieces(batches):
            column = batch.column(1)
            base: list[list] = [[] for _ in range(batch.num_rows)]
            others: list[list] = [[] for _ in range(batch.num_rows)]
            for i in hinted(column).tolist():
                said = column[i].as_py()
                spans = base_spans(said)
                base[i] = [{"start": a, "stop": b, "kind": k} for a, b, k in spans]
                others[i] = [{"start": a, "stop": b, "value": said[a:b]} for a, b, _ in context_values(said) if not any(x < b and a < y for x, y, _ in spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(others, _VALUE)], ["doc_id", "base", "others"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters, none beside a digit or underscore, of all texts; assigned values left out."""

    def run(batches):
        for batch in pieces(batches):
            column = pc.fill_null(batch.column(0), "")
            rows = [i for i in hinted(column).tolist() if NAMED.search(column[i].as_py()) or USERINFO.search(column[i].as_py())]
            if rows:
                texts = column.to_pylist()
                for i in rows:
                    said = list(texts[i])
                    for a, b, assigned in context_values(texts[i]):
                        if assigned:
                            said[a:b] = " " * (b - a)
                    texts[i] = "".join(said)
                column = pa.array(texts, column.type)
            # runs of ASCII letters, digits, underscores and everything else outside ASCII; distinct ones are parted further
            data, offsets = raw(column)
            low = LOWER[data]
            mask = WORD[low] | (low == 0x5F)
            starts, ends = spans(mask, offsets)
            runs = packed(low, mask, starts, ends, pa.string()).dictionary_encode()
            often = np.bincount(runs.indices.to_numpy(), minlength=len(runs.dictionary))
            split = pc.split_pattern_regex(pc.utf8_lower(runs.dictionary), r"[^\p{L}\p{M}\p{N}_]+")
            counted = split.flatten().dictionary_encode()
            n = np.bincount(counted.indices.to_numpy(), np.repeat(often, np.diff(split.offsets.to_numpy())), len(counted.dictionary)).astype(np.int64)
            length = pc.utf8_length(counted.dictionary).to_numpy()
            good = (length >= SHORTEST) & (length <= LONGEST) & pc.match_substring_regex(counted.dictionary, r"^\p{L}+$").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([counted.dictionary.take(pa.array(at)), pa.array(n[at])], ["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranks(counted: DataFrame) -> DataFrame:
    """word, bits: the logarithm of the number of words in the same or a higher class of counts, eight classes to a doubling."""
    classed = counted.withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    # at most eight rows for each bit of a count
    sizes = classed.groupBy("class").count().collect()
    upto, at = {}, 0
    for r in sorted(sizes, reverse=True):
        at += r["count"]
        upto[r["class"]] = math.log2(at)
    if not upto:
        return classed.select("word", F.lit(0.0).alias("bits"))
    table = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])
    return classed.select("word", table[F.col("class")].alias("bits"))


def guessed(values: DataFrame, ranked: DataFrame) -> DataFrame:
    """value, bits, segments of the distinct values of column ``value``."""

    def cut(batches):
        for batch in batches:
            every = [sorted(substrings(v)) for v in batch.column(0).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(pa.array([x for some in every for x in some], pa.string()), at)], ["value", "parts"])

    def cost(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            rows = []
            for value, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits, segments = guess_bits(value, {m["word"]: m["bits"] for m in met or []})
                rows.append((value, bits, [{"start": a, "stop": b, "kind": k} for a, b, k in segments]))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], kind)], ["value", "bits", "segments"])

    distinct = values.select("value").distinct()
    parts = distinct.mapInArrow(cut, "value string, parts array<string>").select("value", F.explode_outer("parts").alias("word"))
    met = parts.join(ranked, "word", "left")
    # a value's words: no more than ``LONGEST`` for each of its places
    known = met.groupBy("value").agg(F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("word", "bits"))).alias("met"))
    return known.mapInArrow(cost, "value string, bits double, segments array<struct<start: int, stop: int, kind: string>>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", strong: float = STRONG) -> DataFrame:
    """doc_id, base and spans (both arrays of start, stop, kind, in order) of every text, bits of the added ones."""
    first = stored(found(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "found")
    others = first.select("row", F.explode("others").alias("o")).select("row", "o.start", "o.stop", "o.value")
    costs = stored(guessed(others, ranks(stored(words(docs, text), "words"))), "guess-costs")
    added = others.join(costs.where(F.col("bits") >= strong).select("value", "bits"), "value").groupBy("row").agg(
        F.collect_list(F.struct("start", "stop", F.lit(KINDS.index("guess")).alias("kind"), "bits")).alias("added"))
    whole = first.join(added, "row", "left")
    more = F.coalesce(F.transform("added", lambda a: F.struct(a["start"], a["stop"], a["kind"])), F.array().cast("array<struct<start: int, stop: int, kind: int>>"))
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return whole.select("doc_id", "base", spans.alias("spans"), F.coalesce(F.transform("added", lambda a: a["bits"]), F.array().cast("array<double>")).alias("bits"))


def written(spans: str):
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")

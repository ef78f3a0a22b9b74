"""Secrets in text: fixed patterns, and a guess-cost model for values that stand in a credential context.

The cost of a value is the cheapest way to write it as words, dates, repeats, keyboard walks and brute-force spans, in
bits; values that cost at least `bits` are reported as spans of kind `guess`. Words come from the corpus itself: the
commonest ones, counted over all documents, cost as much as their rank.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the base patterns
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Keywords in lower-case text; what may stand around them in a name is looked at afterwards.
WORDS = r"pass|pwd|credential|login|bearer|(?:secret|private|access|auth|api)[_. -]?key|secret|token"
STRONG, KEYWORD = re.compile(WORDS), re.compile(f"pin|{WORDS}")
#: `pin` must be a whole part of a name; before `is`, `was` or `to` every keyword must end its part, and `pass` begin it.
PIN = re.compile(r"(?<![A-Za-z])(?:[Pp]in|PIN)(?![a-z])|(?<=[a-z0-9])(?:Pin|PIN)(?![a-z])")
SPOKEN = re.compile(
    r"(?:(?<![A-Za-z])(?i:pass|pin)|(?<=[a-z0-9])(?:Pass|Pin|PIN)"
    r"|(?i:pass(?:word|wd|phrase|code)|pwd|credentials?|login|bearer|(?:secret|private|access|auth|api)[_. -]?key|secret|token))(?![a-z])"
)
NAME = re.compile(r"(?a)\w*+(?:[.-]++\w++)*+")
OPEN = r"""[ \t]*+(?:(?i:bearer)[ \t]++)?+(?:"(?P<d>[^\s"]{6,})|'(?P<s>[^\s']{6,})|`(?P<g>[^\s`]{6,})|(?P<v>[^\s"'`]\S{5,}))"""
ASSIGNED = re.compile(r"""["'`]?+\]?+[ \t]*+(?>=>|->|:=|={1,3}|:)""" + OPEN)
SAID = re.compile(r"""["'`]?+[ \t]++(?:[iI][sS]|[wW][aA][sS]|[tT][oO])(?![^\s"'`])""" + OPEN)
BEARER = re.compile(r"[ \t]++" + OPEN.removeprefix(r"[ \t]*+"))
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(
    r"(?:19|20)\d\d(?P<a>[-/._]?)(?:0[1-9]|1[0-2])(?P=a)(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])(?P<b>[-/._]?)(?:0[1-9]|1[0-2])(?P=b)(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
SEGMENT_BITS = 1.0
LONGEST_WORD = 24


#: Row and column of each key; lower rows stand half a key further right.
PLACE = {c: (y, x + y * 0.5) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


def step(a: str, b: str) -> tuple[float, float] | None:
    """Direction from key a to a key beside it, in the own row or the next one."""
    if a == b or a not in PLACE or b not in PLACE:
        return None
    down, right = PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]
    return (down, right) if abs(down) <= 1 and abs(right) <= 1 else None


def brute_bits(c: str) -> float:
    if c.isascii():
        return math.log2(10) if c.isdigit() else math.log2(26) if c.isalpha() else math.log2(33)
    return 11.0


class Runs:
    """How far a text repeats itself with a period, from any place; a run that was measured once is not measured again."""

    def __init__(self, low: str):
        self.low = low
        self.known: dict[int, tuple[int, int]] = {}

    def repeated(self, i: int, period: int) -> int:
        """Number of characters from i on that equal those `period` later."""
        begin, end = self.known.get(period, (0, 0))
        if begin <= i < end:
            return end - i
        low, n, size = self.low, len(self.low) - period, 0
        block = 1
        while block and i + size < n:
            block = min(block, n - i - size)
            if low[i + size : i + size + block] == low[i + size + period : i + size + period + block]:
                size += block
                block *= 2
            else:
                block //= 2
        if size:
            self.known[period] = (i, i + size)
        return size


def walk_from(low: str, i: int, most_turns: float) -> tuple[int, int]:
    """Length of the keyboard walk from i on and its turns; a walk that turns more than `most_turns` times is cut off."""
    length, turns, before = 1, 0, None
    while i + length < len(low) and (way := step(low[i + length - 1], low[i + length])):
        turns += before is not None and way != before
        if turns > most_turns:
            break
        before = way
        length += 1
    return length, turns


def guess_bits(value: str, ranks: Mapping[str, int], enough: float = math.inf) -> float:
    """Bits of the cheapest segmentation; `ranks` holds words in lower case with their rank from 1.

    Places are settled in the order of their cost, so only places that cost less than the answer are looked at: with
    `enough`, a number that does not grow with the value. Once every segmentation costs `enough`, a lower bound of that
    size is given.
    """
    n, low = len(value), lower_in_place(value)
    runs = Runs(low)
    # (place, False) ends a segment; (place, True) is inside a brute-force span
    best: dict[tuple[int, bool], float] = {(0, False): 0.0}
    heap = [(0.0, 0, False)]

    def reach(j: int, bits: float, inside: bool = False) -> None:
        if bits < best.get((j, inside), math.inf):
            best[j, inside] = bits
            heapq.heappush(heap, (bits, j, inside))

    while True:
        here, i, inside = heapq.heappop(heap)
        if here > best[i, inside]:
            continue
        if here >= enough or (i == n and not inside):
            return here
        if inside:
            reach(i, here)
            if i < n:
                reach(i + 1, here + brute_bits(value[i]), True)
            continue
        here += SEGMENT_BITS
        reach(i + 1, here + brute_bits(value[i]), True)
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                case = 0.0 if not upper else 1.0 if upper == j - i or value[i].isupper() and upper == 1 else float(j - i)
                reach(j, here + math.log2(rank + 1) + case)
        same = runs.repeated(i, 1) + 1
        if same >= 3:
            for k in (3, same):
                reach(i + k, here + brute_bits(value[i]) + math.log2(k))
        walk, turns = walk_from(low, i, (enough - here) / 2.0)
        if walk >= 4:
            reach(i + walk, here + math.log2(len(PLACE)) + math.log2(walk) + 2.0 * (1 + turns))
        for block in range(2, min((n - i) // 2, LONGEST_WORD) + 1):
            times = runs.repeated(i, block) // block + 1
            if times > 1:
                reach(i + times * block, here + sum(map(brute_bits, value[i : i + block])) + math.log2(times))
        m = DATE.match(value, i)
        if m:
            reach(m.end(), here + (7.0 if m.end() - i == 4 else 7.0 + math.log2(365) + 1.0))
            reach(i + 4, here + 7.0) if value[i : i + 2] in ("19", "20") and value[i : i + 4].isdigit() else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, ends exclusive, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def lower_in_place(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def without_tail(value: str) -> str:
    """A value without quotes loses the marks that end a clause and brackets it did not open."""
    end = len(value)
    while end:
        c = value[end - 1]
        if c in ".,:;!?\"'`" or c in CLOSERS and value.count(CLOSERS[c], 0, end) < value.count(c, 0, end):
            end -= 1
        else:
            break
    return value[:end]


def contexts(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of what stands in a credential context: a keyword anywhere in a name (letters, digits, `_`, `-`, `.`), a
    separator, and the value up to white space or the partner of its opening quote; after `bearer` no separator is needed.

    A value is searched for contexts too, so one value may be given several times, and parts of it.
    """
    seen = -1
    for m in KEYWORD.finditer(lower_in_place(text)):
        if m.end() <= seen:
            continue  # another keyword of the same name
        first = m.start()
        seen = end = NAME.match(text, m.end()).end()
        if m[0] == "pin" and not PIN.search(text, first, end) and not STRONG.search(text[m.end() : end].lower()):
            continue
        found = ASSIGNED.match(text, end)
        if not found and SPOKEN.search(text, first, end):
            found = SAID.match(text, end)
        if not found and text[max(end - 6, 0) : end].lower() == "bearer":
            found = BEARER.match(text, end)
        if found:
            kind = found.lastgroup
            yield found.start(kind), without_tail(found[kind]) if kind == "v" else found[kind]


def guess_spans(text: str, ranks: Mapping[str, int], bits: float) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost at least `bits`, without those inside another."""
    found: list[tuple[int, int, int]] = []
    for start, value in sorted(set(contexts(text))):
        if (not found or start >= found[-1][2]) and len(value) >= 6 and guess_bits(value, ranks, bits) >= bits:
            found.append((start, 3, start + len(value)))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def common_words(docs: DataFrame, size: int = 20_000, text: str = "text") -> dict[str, int]:
    """Rank of the `size` commonest words of 2 to 24 letters over all whole texts; ties in alphabetical order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            clean: Counter[str] = Counter()
            for w, n in count.items():
                w = w.strip(".,;:!?\"'()[]")
                if w.isalpha() and 2 <= len(w) <= LONGEST_WORD:
                    clean[w] += n
            return pa.record_batch([pa.array(list(clean), pa.string()), pa.array(list(clean.values()), pa.int64())], ["word", "n"])

        count: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    count.update(t.lower().split())
                if len(count) > 300_000:
                    yield out()
                    count.clear()
        yield out()

    counts = docs.select(F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return {r.word: i for i, r in enumerate(top, 1)}


def secrets_of(docs: DataFrame, bits: float = 40.0, dictionary_size: int = 20_000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans for every row of `docs`.

    Null text is empty: no spans, the digest of the empty string. Rows that repeat get the same answer each; other
    columns are ignored; an empty table gives an empty result. The dictionary holds the `dictionary_size` commonest
    words of the corpus, so what is sent to the tasks is bounded by that parameter.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs, dictionary_size, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                kinds = Counter(k for _, k, _ in base)
                more = guess_spans(t, ranks.value, bits)
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((kinds[0], kinds[1], kinds[2], len(more), digest, written(sorted(base + more))))
            columns = list(zip(*rows)) or [()] * 6
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds_of))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)

"""Secret scans: fixed patterns, and password guess cost by dynamic programming over credential-context values.

A value that stands in a credential context is cut into dictionary words, dates, repeats, keyboard walks and brute-force
spans so that the log10 of the guesses needed is least. Values of fixed patterns get this figure as a column; values in
wider contexts that the patterns don't cover become spans of their own, kind `guess`, if they are costly to guess.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents, map_column, map_slices, map_texts, small_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential's name, alone or in an identifier with _ or -, and the value up to a blank: quoted or not.
CONTEXT = re.compile(
    r"""(?i:(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|private|access|client|signing|encryption|secret|account)[_-]?key|(?<![a-z0-9])(?:pass|auth(?:orization)?|bearer)(?![a-z0-9]))s?(?:[_-]{1,3}[a-z0-9]{0,40}+){0,8}+)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:(?i:bearer|basic)\x20+)?(?:"(?P<double>(?:\\\S|[^"\\\s])+)|'(?P<single>(?:\\\S|[^'\\\s])+)|(?P<bare>(?:(?!&[A-Za-z0-9_.-]+=)[!-~])+))""",
    re.ASCII,
)
#: Frequent password words, most frequent first; the rank is the guess.
WORDS = """password admin welcome dragon monkey login master princess qwerty sunshine letmein shadow football baseball
superman batman trustno iloveyou michael jordan hunter summer winter spring autumn secret access flower hello charlie
donald freedom whatever ginger cheese computer internet service server test guest root user default changeme example
company manager system database oracle mysql postgres ubuntu private public token apikey key pass word love star money
angel lucky happy soccer hockey killer george andrew thomas robert daniel jessica ashley amanda nicole orange yellow
purple silver golden diamond matrix phoenix tiger eagle bear wolf cat dog house green blue black white red the and you
are not for with demo sample temp dummy staging prod production dev""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words of the corpus: letters, the distinct ones that a task counts before it hands them on.
CORPUS_WORD, HANDED_ON = re.compile(r"[a-z]{3,20}"), 300_000
LONGEST = 20
#: The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {
    (a, b) for up, low in zip(ROWS, ROWS[1:]) for i, x in enumerate(low) for y in up[i : i + 2] for a, b in ((x, y), (y, x))
}
#: The digit row with shift.
SHIFTED = str.maketrans("!@#$%^&*()", ROWS[0])
#: Whether a value has a block of characters that is there twice in a row.
BLOCK = re.compile(rf"(.{{2,{LONGEST}}})\1", re.DOTALL)
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the least guesses over all segmentations; time in proportion to the length. Repeats are of a character or of a
    block of LONGEST at most, whose own guesses count once; with shift, keys of the digit row are the same keys."""
    alphabet = sum(k for k, p in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"\d"), (33, r"[^A-Za-z0-9]")) if re.search(p, value)) or 1
    return _cost(value, ranks, alphabet, {})


def _cost(value: str, ranks: dict[str, int], alphabet: int, blocks: dict[str, float]) -> float:
    """The guess cost over an alphabet of that size; blocks: the costs of blocks so far."""
    n = len(value)
    low = value.lower()
    plain, keys = low.translate(LEET), low.translate(SHIFTED)
    periods = range(2, min(LONGEST, n // 2) + 1) if BLOCK.search(value) else ()
    again = [0] * (LONGEST + 1)  # by period, how many characters on end equal those a period before
    brute, best = math.log10(alphabet), [0.0] + [math.inf] * n
    walk = same = 0  # lengths of the walk and of the repeat that end before the current character
    dates: dict[int, list[int]] = {}
    for m in (m for i in range(n) if value[i].isdigit() and (m := DATE.match(value, i))):
        dates.setdefault(m.end(), []).append(m.start())
    for j in range(1, n + 1):
        cost = best[j - 1] + brute
        for i in range(max(0, j - LONGEST), j - 2):
            if rank := ranks.get(low[i:j]) or ranks.get(plain[i:j]):
                changed = (low[i:j] not in ranks) + (value[i:j] not in (low[i:j], low[i:j].upper(), low[i:j].capitalize()))
                cost = min(cost, best[i] + math.log10(rank + 1) + 0.3 * (value[i:j] != low[i:j]) + changed)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + math.log10(365 * 120 if j - i > 4 else 120))
        walk = walk + 1 if j > 1 and (keys[j - 2], keys[j - 1]) in NEXT else 0
        same = same + 1 if j > 1 and value[j - 2] == value[j - 1] else 0
        for run, start in ((walk, 47.0), (same, float(alphabet))):
            if run >= 2:
                cost = min(cost, best[j - 1 - run] + math.log10(start * 2 * (run + 1)))
        for period in periods:
            if j <= period or value[j - 1] != value[j - 1 - period]:
                again[period] = 0
                continue
            again[period] += 1
            if (times := again[period] // period + 1) > 1:
                block = value[j - period : j]
                if block not in blocks:
                    blocks[block] = _cost(block, ranks, alphabet, blocks)
                cost = min(cost, best[j - period * times] + blocks[block] + math.log10(2 * times))
        best[j] = cost
    return best[n]


def scan(text: str, least: float, least_chars: int, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind's number, end) in order; the highest guess cost of a credential-context value, or -1."""
    found, most = [], -1.0
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end()))
            most = max(most, guess_cost(m[2], ranks))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    covered = sorted((start, end) for start, _, end in found)
    at = far = 0
    for m in CONTEXT.finditer(text):
        start = m.start(m.lastgroup)
        value = m[m.lastgroup].rstrip("\"'`,;)]}>") if m.lastgroup == "bare" else m[m.lastgroup]
        while at < len(covered) and covered[at][0] <= start:  # the furthest end of what starts no later
            far, at = max(far, covered[at][1]), at + 1
        if len(value) >= least_chars and start + len(value) > far and (cost := guess_cost(value, ranks)) >= least:
            found.append((m.start(), 3, start + len(value)))
            most = max(most, cost)
    found.sort()
    return found, most


def dictionary(docs: DataFrame, text_col: str = "text", most: int = 20_000) -> dict[str, int]:
    """Ranks of words: the fixed ones, and the `most` most frequent of all texts, ties by the alphabet. A word that is both
    has the lower rank."""

    def rows(_, texts):
        seen: Counter = Counter()
        for text in texts:
            seen.update(CORPUS_WORD.findall(text.lower()))
            if len(seen) > HANDED_ON:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "words")
    counts = scratch.write(map_slices(texts, rows, "word string, n long", size=100_000).groupBy("word").agg(F.sum("n").alias("n")))
    # only words as frequent as to be among the most: by powers of two, a few rows
    power = F.floor(F.log2("n")).cast("int")
    seen, least = 0, 0
    for r in sorted(counts.groupBy(power.alias("p")).agg(F.count("*").alias("words")).collect(), reverse=True):
        seen, least = seen + r.words, r.p
        if seen >= most:
            break
    best = scratch.write(counts.where(power >= least).orderBy(F.desc("n"), "word").limit(most))
    found = [r.word for r in best.orderBy(F.desc("n"), "word").select("word").collect()]  # `most` rows
    ranks = dict(RANK)
    for i, w in enumerate(found):
        ranks[w] = min(i + 1, ranks.get(w, i + 1))
    return ranks


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_log10_guesses: float = 8.0, least_chars: int = 8) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> by start and kind, max_log10_guesses double (-1: no such value).

    Whole texts; offsets are code points, ends exclusive. Null and empty texts give no spans. A row for each row of docs,
    repeated and null ids included; of spans with one start the kinds go in their order. Words that are cheap to guess are
    the fixed ones and the corpus's own (see `dictionary`). An empty table gives no rows; other columns are ignored.
    """
    ranks = dictionary(docs, text_col)

    def row(_, doc_id, text):
        found, most = scan(text, least_log10_guesses, least_chars, ranks)
        return doc_id, [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found], most

    return map_texts(documents(docs, id_col, text_col), row, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, max_log10_guesses double")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_log10_guesses: float = 8.0, least_chars: int = 8) -> DataFrame:
    """docs with every span replaced by `[SECRET]` in text_col (overlapping spans by one), other columns as they were."""

    ranks = dictionary(docs, text_col)

    def clean(_, text: str | None) -> str | None:
        if not text:
            return text
        found, _ = scan(text, least_log10_guesses, least_chars, ranks)
        if not found:
            return text
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return docs.withColumn(text_col, map_column(docs, text_col, clean, "string"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The spans as counts, a digest of the fixed patterns' spans, and a string of all."""
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(as_text(F.filter("spans", lambda s: s["kind"] != KINDS[-1])), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        "max_log10_guesses",
    )

"""Secret scans, in DataFrame functions only.

Patterns find three kinds of secrets by form. Beside them, candidate strings (20 or more characters of the base64 or
URL alphabet in which a letter and a digit meet) are scored by the Shannon entropy of a sliding window. The state of
the slide is one count per symbol and the sum of n*log2(n) over the symbols: a symbol that enters or leaves changes
one count and two terms of the sum. A candidate is a secret if the highest window entropy reaches the threshold of its
character class and no allow-list pattern matches it.

Time is linear in the text, whatever the number of matches or the length of a candidate: running positions are folded
in chunks, since appending to one array is quadratic, and candidates are cut into overlapping pieces.

Spans count code points, end exclusive. Null and empty texts have no spans; ties in start are ordered by kind; each
row is scanned by itself, so repeated rows get equal results and rows without an id too; an empty table gives no rows.
Other columns, of whatever names, stay as they are in redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: The forms, their least length, the group that is the span.
ASSIGN_HEAD = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits per symbol that a window must reach, by character class.
WINDOW = 20
BITS = {"hex": 2.9, "base32": 3.3, "base64": 3.6}
#: A letter beside a digit. Candidates without are words and numbers, joined by dashes, underlines or slashes.
MEET = r"[0-9][A-Za-z]|[A-Za-z][0-9]"
#: Candidates that match one of these are no secrets: UUIDs, examples, runs of one symbol.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|abcdefgh|01234567",
    r"(.)\1{7}",
)
CHUNK, PIECE = 256, 4096
SPAN = "array<struct<start:int,kind:string,end:int>>"


def running(items: Column, zero: Column, step, out: str, finish=lambda carry, got: got, chunk: int = CHUNK) -> Column:
    """Fold over an array with output: step(carry, item) is a struct (carry, out); finish gets the last carry and the array of all out."""

    def whole(xs):
        none = F.array().cast(f"array<{out}>")

        def part(acc, k):
            fold = F.aggregate(F.slice(xs, k * chunk + 1, F.lit(chunk)), F.struct(acc["carry"].alias("carry"), none.alias("got")), lambda a, x: let(step(a["carry"], x), lambda r: F.struct(r["carry"].alias("carry"), F.concat(a["got"], F.array(r["out"])).alias("got"))))
            return let(fold, lambda p: F.struct(p["carry"].alias("carry"), F.concat(acc["got"], F.array(p["got"])).alias("got")))

        chunks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(chunks, F.struct(zero.alias("carry"), F.array().cast(f"array<array<{out}>>").alias("got")), part, lambda a: finish(a["carry"], F.flatten(a["got"])))

    return let(items, whole)


def spans(text: Column, pattern: str, least: int = 1, head: str | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct(start, end, text)>: lengths of the pieces between the matches add up to the positions.
    head: the beginning of a match that isn't part of the span."""

    def step(at, pair):
        start = at + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        inner = start + F.length(F.regexp_extract(pair["match"], f"^{head}", 0)) if head else start
        return F.struct(end.alias("carry"), F.struct(inner.alias("start"), end.alias("end"), pair["match"].alias("text")).alias("out"))

    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.arrays_zip(m.alias("match"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("piece")))
    return F.filter(running(pairs, F.lit(0), step, "struct<start:int,end:int,text:string>"), lambda s: s["end"] - s["start"] >= least)


def named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per symbol, of the windows of a string of SYMBOLS."""
    term = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))

    def slide(piece):
        # Counts are the letters of a string, "@" is 0. A move is a symbol's number, negative where the symbol leaves.
        def step(acc, move):
            at = F.abs(move)
            n = F.ascii(F.substr(acc["counts"], at, F.lit(1))) - 64
            m = n + F.signum(move).cast("int")
            s = acc["sum"] + F.get(term, m) - F.get(term, n)
            size = acc["size"] + F.signum(move).cast("int")
            return let(F.struct(s.alias("sum"), size.alias("size")), lambda x: F.struct(
                F.overlay(acc["counts"], F.char(m + 64), at, F.lit(1)).alias("counts"), x["sum"].alias("sum"), x["size"].alias("size"),
                F.when(x["size"] == window, F.greatest(acc["best"], math.log2(window) - x["sum"] / window)).otherwise(acc["best"]).alias("best")))

        zero = F.struct(F.lit("@" * len(SYMBOLS)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("size"), F.lit(0.0).alias("best"))
        codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
        moves = let(codes, lambda xs: F.flatten(F.transform(xs, lambda c, i: F.when(i >= window, F.array(-F.get(xs, i - window), c)).otherwise(F.array(c)))))
        return F.aggregate(moves, zero, step, lambda a: a["best"])

    def pieces(parts):
        return F.array_max(F.transform(parts, lambda p, i: slide(F.when(i > 0, F.concat(F.right(F.get(parts, i - 1), F.lit(window - 1)), p)).otherwise(p))))

    return let(F.regexp_extract_all(candidate, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), pieces)


def is_secret(candidate: Column, window: int = WINDOW, bits: dict = BITS, allow=ALLOW) -> Column:
    threshold = F.when(candidate.rlike("^[0-9a-fA-F]++$"), bits["hex"]).when(candidate.rlike("^[A-Z0-9]++$"), bits["base32"]).otherwise(bits["base64"])
    allowed = F.lit(False)
    for p in allow:
        allowed = allowed | candidate.rlike(p)
    return F.when(candidate.rlike(MEET) & ~allowed, window_entropy(candidate, window) >= threshold).otherwise(F.lit(False))


def _scanned(docs: DataFrame, **options) -> DataFrame:
    """row (all columns), text, assign, access, hex, entropy. Each pattern runs over each text once to find and once to split, and only
    where a cheaper test finds its beginning."""
    none = F.array().cast(SPAN)
    only = lambda test, out: F.when(test, out).otherwise(none)
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    return d.withColumns({
        "assign": only(t.rlike(r"(?i)passw|secret|token|api_?key"), named(spans(t, ASSIGN, 6, ASSIGN_HEAD), "assign")),
        "access": only(t.contains("AKIA"), named(spans(t, ACCESS, 20), "access")),
        "hex": only(t.rlike(HEX), named(spans(t, HEX, 24), "hex")),
        "entropy": only(t.rlike(MEET) & t.rlike(CANDIDATE), named(F.filter(spans(t, CANDIDATE, 20), lambda s: is_secret(s["text"], **options)), "entropy")),
    })


def scan(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """Adds _assign, _access, _hex and _entropy, arrays of (start, kind, end), to the kept columns."""
    d = _scanned(docs.select(*dict.fromkeys([*keep, "text"])), **options)
    return d.select(*(F.col("row").getField(c).alias(c) for c in keep), *(F.col(c).alias(f"_{c}") for c in ("assign", "access", "hex", "entropy")))


def joined(*arrays: Column) -> Column:
    """kind:start:end by start, then kind in the order assign, access, hex, entropy."""
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    rows = F.transform(F.concat(*arrays), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut(text: Column, found: Column, mark: str) -> Column:
    """The text with a mark for each of the sorted spans (start, end); spans that overlap share one. Text is read from blocks of PIECE
    characters, since a substring counts its way from the beginning."""

    def stretch(blocks, a, b):
        def piece(k):
            low = F.greatest(a - k * PIECE, F.lit(0))
            return F.substr(F.get(blocks, k), low + 1, F.least(b - k * PIECE, F.lit(PIECE)) - low)

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), piece), "")).otherwise("")

    def step(at, s):
        gap = F.when(s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(at, s["end"]).alias("carry"), gap.alias("out"))

    gaps = running(found, F.lit(0), step, "struct<a:int,b:int>", lambda at, got: F.concat(F.array_compact(got), F.array(F.struct(at.alias("a"), F.length(text).alias("b")))))
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda blocks: F.array_join(F.transform(gaps, lambda g: stretch(blocks, g["a"], g["b"])), mark))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by a mark, overlapping spans by one. Other columns stay, n_chars follows the text."""
    d = _scanned(docs, **options)
    rows = F.array_sort(F.transform(F.concat("assign", "access", "hex", "entropy"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    d = d.select("row", "text", rows.alias("found")).select("row", F.when(F.size("found") > 0, cut(F.col("text"), F.col("found"), mark)).alias("clean"))
    old = lambda c: F.col("row").getField(c)
    new = {"text": F.coalesce("clean", old("text")), "n_chars": lambda t: F.coalesce(F.length("clean").cast(t), old("n_chars"))}
    return d.select(*((new["n_chars"](t) if c == "n_chars" else new["text"] if c == "text" else old(c)).alias(c) for c, t in docs.dtypes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [F.col(c) for c in ("_assign", "_access", "_hex")]
    n = lambda c: F.size(c).cast("long")
    return d.select("doc_id", n("_assign").alias("n_assign"), n("_access").alias("n_access"), n("_hex").alias("n_hex"), F.sha2(joined(*base).cast("binary"), 256).alias("base_sha256"), joined(*base, F.col("_entropy")).alias("spans"))


def _sql() -> str:
    """The query in SQL: windows are taken one by one. Its patterns know no references, look-behind or ASCII-only ignoring of case."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    head = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?"""
    runs = "|".join(f"{'[' + c + ']' if c in '+/_=-' else c}{{8}}" for c in SYMBOLS)
    words = "|".join(map(either, ("example", "sample", "placeholder", "abcdefgh", "01234567")))
    kinds = ((0, "assign", head + "[A-Za-z0-9+/_.=-]+", 6), (1, "access", ACCESS, 20), (2, "hex", "[0-9a-f]+", 24), (3, "entropy", "[A-Za-z0-9+/_=-]+", 20))
    one = "\nUNION ALL ".join(f"SELECT rid, {r} AS rank, '{k}' AS kind, {n} AS least, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS p FROM t" for r, k, p, n in kinds)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({one}),
u AS (SELECT rid, rank, kind, least, m[i] AS c, coalesce(list_sum(list_transform(p[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0) AS stop
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
s AS (SELECT *, stop - length(c) + CASE WHEN rank = 0 THEN length(regexp_extract(c, '^{head}')) ELSE 0 END AS start FROM u),
e AS (SELECT * FROM s WHERE stop - start >= least AND (rank < 3 OR (
      regexp_matches(c, '{MEET}') AND NOT regexp_matches(c, '{ALLOW[0]}') AND NOT regexp_matches(c, '{words}') AND NOT regexp_matches(c, '{runs}')
      AND list_max(list_transform(range(0, greatest(length(c) - {WINDOW - 1}, 0)), lambda i: list_aggregate(string_split(substr(c, i + 1, {WINDOW}), ''), 'entropy')))
          >= CASE WHEN regexp_full_match(c, '[0-9a-fA-F]+') THEN {BITS['hex']} WHEN regexp_full_match(c, '[A-Z0-9]+') THEN {BITS['base32']} ELSE {BITS['base64']} END))),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS h,
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM e GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)
"""


SQL = _sql()

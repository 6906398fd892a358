"""Secret scans with DataFrame functions alone.

Three fixed patterns give the base spans. Beside them, candidate strings (runs of at
least WINDOW key characters that mix digits and letters) are judged by the Shannon
entropy of a window that slides over them. A window's sum of c * log2(c) over its
counts c is kept by two updates a step: one for the character that enters, one for
the one that leaves, each from that character's count alone, so that a candidate's cost is
linear in its length. A candidate whose best window reaches its character class's
threshold is a span of kind entropy, unless the allow list names it or a base span
holds it.

Positions are code points, ends exclusive. A pattern's places follow from splitting
the text at its matches: what stands between them and the matches themselves alternate.

Cases: null and empty text have no spans (counts 0, the SHA-256 of nothing, spans ""); a
text of any length is scanned whole; repeated rows give repeated results; an empty table
gives no rows; names of other columns don't matter, they are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int
    least: int


# The base patterns, the group whose length counts, and the least length.
PATTERNS = (
    Pattern("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16),
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),
)
WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
#: Character class, its characters, and the least entropy in bits of a window of WINDOW characters.
CLASSES = (
    ("hex", "^[0-9A-Fa-f]+$", 3.0),
    ("base64", "^[A-Za-z0-9+/_-]+$", 3.9),
)
#: Candidates that no secret is: identifiers in UUID form, dates and times, examples, alphabets and counting, paths of words.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxx",
    r"(?i)0123456|abcdefg|qwerty",
    r"(/[a-z_-]+){3}",
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _places(text: Column, regex: str) -> tuple[Column, Column]:
    """All matches and, for each, the code point where it starts."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.split(text, regex, -1)
    steps = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    walked = F.aggregate(
        F.slice(steps, 1, F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")),
        lambda s: s["starts"],
    )
    return found, walked


def _spans(text: Column, pattern: Pattern, rank: int) -> Column:
    found, starts = _places(text, pattern.regex)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group)), F.length)
    rows = F.transform(
        F.arrays_zip(starts.alias("start"), F.transform(found, F.length).alias("size"), counted.alias("counted")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + x["size"]).alias("end"), F.lit(pattern.kind).alias("kind"), x["counted"].alias("counted")),
    )
    kept = F.transform(F.filter(rows, lambda x: x["counted"] >= pattern.least), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
    return F.when(text.rlike(pattern.regex), kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The greatest entropy, in bits, of any window of the string; null if it is shorter.

    The string is taken apart once. What a window's counts change by follows from how often
    the character that enters stands in the window already, and the one that leaves still.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"))

    def best(chars: Column) -> Column:
        def times(first: Column, size: Column, char: Column) -> Column:
            return F.size(F.filter(F.slice(chars, first, size), lambda c: c == char))

        def step(s: Column, i: Column) -> Column:
            full = i > window
            gone = F.when(full, times(F.greatest(i - window, F.lit(1)), F.lit(window), F.element_at(chars, F.greatest(i - window, F.lit(1))))).otherwise(0)
            came = times(F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)), F.element_at(chars, i))
            total = s["sum"] - _weight(gone) + _weight(F.greatest(gone - 1, F.lit(0))) - _weight(came - 1) + _weight(came)
            return F.struct(total.alias("sum"), F.when(i >= window, F.least(s["best"], total)).otherwise(s["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda s: F.log2(F.lit(float(window))) - s["best"] / window)

    return F.element_at(F.transform(F.array(F.regexp_extract_all(value, F.lit("."), F.lit(0))), best), 1)


def _entropic(value: Column) -> Column:
    allowed = F.lit(False)
    for regex in ALLOWED:
        allowed = allowed | value.rlike(regex)
    judged = F.lit(False)
    for _, shape, least in reversed(CLASSES):
        judged = F.when(value.rlike(shape), window_entropy(value) >= least).otherwise(judged)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~allowed & F.coalesce(judged, F.lit(False))


def _entropy_spans(text: Column, base: Column) -> Column:
    found, starts = _places(text, CANDIDATE)
    rows = F.filter(
        F.arrays_zip(starts.alias("start"), found.alias("value")),
        lambda x: x["value"].rlike("[0-9]") & ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["start"] + F.length(x["value"]))) & _entropic(x["value"]),
    )
    spans = F.transform(rows, lambda x: F.struct(x["start"], F.lit(len(PATTERNS)), x["start"] + F.length(x["value"]), F.lit("entropy")))
    return F.when(text.rlike(CANDIDATE), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def find_secrets(docs: DataFrame, text_column: str = "text", base_name: str = "base_spans", all_name: str = "all_spans") -> DataFrame:
    """docs with base_name and all_name, arrays of (start, rank, end, kind) by start and kind."""
    text = F.coalesce(docs[text_column], F.lit(""))
    base = docs.withColumn(base_name, F.array_sort(F.concat(*(_spans(text, p, rank) for rank, p in enumerate(PATTERNS)))))
    return base.withColumn(all_name, F.array_sort(F.concat(base_name, _entropy_spans(text, F.col(base_name)))))


def _free(name: str, taken: list[str]) -> str:
    """name, or name with as many underlines as make it none of those taken, whatever their case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")))
    counts = [F.size(F.filter("base_spans", _of_kind(p.kind))).cast("long").alias(f"n_{p.kind}") for p in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mark, overlapping ones by one; other columns stay, null text stays null."""
    names = docs.columns
    text, base, every = F.col(text_column), _free("base_spans", names), _free("all_spans", names)
    done = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))),
    )
    return find_secrets(docs, text_column, base, every).withColumn(text_column, F.when(F.size(every) > 0, done).otherwise(text)).select(*names)

"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong patterns (an assignment to a secret's name, an access identifier, a long
hexadecimal run) report every match. Weak patterns (other key identifiers,
40-character keys and endpoints) are common in clean text and are reported only
where complementary parts co-occur: an interval join looks for the other parts
within ``SCOPE`` code points in the same document, by cells of that width and
their neighbours, as semi joins that give no pairs.

Spans are found by splitting: a text is cut at the matches, and the lengths of
the pieces and matches, summed in order, are the offsets.

Defined results: null and empty texts have no spans and the digest of the empty
string; each of several equal rows is scanned and reported for itself; an
empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Pattern:
    """A kind of span. part: access, secret or endpoint; needs: parts of which all must be near for a weak one."""

    kind: str
    regex: str
    part: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


#: Fixed patterns of the strong kinds, in the order of reports. Runs are written with their least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = (
    Pattern("assign", ASSIGN, "secret", group=2, least=12),
    Pattern("access", r"AKIA[A-Z0-9]{14,}", "access"),
    Pattern("hex", r"[0-9a-f]{16,}", "secret"),
)
WEAK = (
    Pattern("weak_access", r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA|SKIA)[A-Z0-9]{12,16}(?![A-Za-z0-9])", "access", needs=("secret",)),
    Pattern("weak_secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "secret", needs=("access",)),
    Pattern("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""", "endpoint", needs=("access", "secret")),
)
SCOPE = 400


def _found(text: Column, number: int, pattern: Pattern) -> Column:
    """Kind, lengths of matches and of the pieces before them, and whether each match is long enough."""
    matches = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group)) if pattern.group else matches
    pieces = F.split(text, pattern.regex, -1)
    rows = F.zip_with(
        F.transform(pieces, lambda p: F.length(p)),
        F.arrays_zip(F.transform(matches, lambda m: F.length(m)).alias("size"), F.transform(checked, lambda m: F.length(m)).alias("checked")),
        lambda piece, m: F.struct(piece.alias("before"), m["size"].alias("size"), m["checked"].alias("checked")),
    )
    return F.when(text.rlike(pattern.regex), F.struct(F.lit(number).alias("number"), rows.alias("rows")))


def find_spans(docs: DataFrame, patterns: tuple[Pattern, ...] = STRONG + WEAK) -> DataFrame:
    """row, doc_id, number (of the pattern), start and end of each match; a row without matches has one line with nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.array_compact(F.array(*[_found(text, i, p) for i, p in enumerate(patterns)]))
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), kinds.alias("kinds"))
    by_kind = numbered.select("doc_id", "row", F.explode_outer("kinds").alias("found"))
    each = by_kind.select("doc_id", "row", F.col("found.number").alias("number"), F.posexplode_outer("found.rows").alias("at", "m"))
    # a running sum over the matches of one kind in one text
    upto = Window.partitionBy("row", "number").orderBy("at")
    end = F.sum(F.col("m.before").cast("long") + F.coalesce(F.col("m.size"), F.lit(0))).over(upto)
    least = F.element_at(F.array(*[F.lit(p.least) for p in patterns]), F.col("number") + 1)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    good = F.col("m.size").isNotNull() & (F.col("m.checked") >= least)
    hit = lambda c: F.when(good, F.col(c)).alias(c)
    # the piece after the last match keeps a line for its text, without a span
    return placed.where(good | F.col("m.size").isNull()).select("row", "doc_id", hit("number"), hit("start"), hit("end"))


def link(spans: DataFrame, patterns: tuple[Pattern, ...] = STRONG + WEAK, scope: int = SCOPE) -> DataFrame:
    """Strong spans, and weak ones whose complementary parts lie within scope code points in the same row."""
    part = F.element_at(F.array(*[F.lit(p.part) for p in patterns]), F.col("number") + 1)
    weak = [i for i, p in enumerate(patterns) if p.needs]
    near = spans.where("number is not null").withColumn("part", part)
    kept = spans.where(F.col("number").isNull() | ~F.col("number").isin(weak))
    for i in weak:
        left = spans.where(F.col("number") == i)
        for need in patterns[i].needs:
            # a part lies in each cell of scope that it touches; a candidate asks its own cells and those beside them
            cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope).cast("long"), F.floor(b / scope).cast("long")))
            other = near.where(F.col("part") == need).select(F.col("row").alias("_row"), F.col("start").alias("_s"), F.col("end").alias("_e"), cells(F.col("start"), F.col("end")).alias("_cell"))
            asked = left.withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
            close = (F.col("_s") <= F.col("end") + scope) & (F.col("_e") >= F.col("start") - scope)
            met = asked.join(other, (F.col("row") == F.col("_row")) & (F.col("cell") == F.col("_cell")) & close, "left_semi")
            left = met.drop("cell").distinct()
        kept = kept.unionByName(left)
    return kept


def scan(docs: DataFrame, patterns: tuple[Pattern, ...] = STRONG + WEAK, scope: int = SCOPE) -> DataFrame:
    """doc_id, a count of each strong kind, base_sha256 and spans of each row."""
    strong = [p for p in patterns if not p.needs]
    linked = link(cut(find_spans(docs.select("doc_id", "text"), patterns)), patterns, scope)
    span = F.when(F.col("number").isNotNull(), F.struct("start", "number", "end"))
    rows = linked.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("number") == i, 1)).alias(f"n_{p.kind}") for i, p in enumerate(patterns) if not p.needs],
        F.array_sort(F.collect_list(span)).alias("_all"),
    )
    names = F.array(*[F.lit(p.kind) for p in patterns])
    told = lambda s: F.concat_ws(":", F.element_at(names, s["number"] + 1), s["start"], s["end"])
    base = F.filter("_all", lambda s: s["number"] < len(strong))
    return rows.select(
        "doc_id",
        *[f"n_{p.kind}" for p in strong],
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("_all", told), ",").alias("spans"),
    )

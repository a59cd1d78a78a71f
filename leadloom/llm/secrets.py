"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import cut, read_documents

#: Kinds in listed order: pattern, the group that holds the credential, its least length. Fixed values.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Patterns that find the same matches of sufficient length, or none, fast.
SCREEN = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: Longer runs alone can match for these kinds, so short runs need not be listed.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: A bare token: 12 or more credential characters, a digit among them.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}"
#: A value that this many owners hold is a widely copied example.
EXAMPLE_OWNERS = 3
#: So is one in this many repositories, whoever owns them.
EXAMPLE_REPOSITORIES = 20

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


#: Numbers are summed in blocks of so many, then blocks: arrays that grow by copying stay short.
BLOCK = 256


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once although use names it within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(values: Column, first: Column) -> Column:
    """first plus the sum of the values before each value."""
    start = F.struct(first.alias("p"), F.array().cast("array<int>").alias("s"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["p"] + x).alias("p"), F.array_append(a["s"], a["p"]).alias("s")), lambda a: a["s"])


def _running(values: Column) -> Column:
    """For each value the sum of those before it."""
    def by_blocks(v: Column) -> Column:
        n = F.ceil(F.size(v) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, _sums_before(sums, F.lit(0)), _sums_before))

    return _once(values, by_blocks)


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of a pattern: text between matches and the matches give the starts by running sums of lengths."""
    def of(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        sizes = F.transform(found, F.length)
        starts = _running(F.flatten(F.zip_with(gaps, sizes, lambda g, m: F.array(g, m))))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        starts = F.filter(starts, lambda x, i: i % 2 == 1)  # of the matches
        rows = F.arrays_zip(starts.alias("s"), sizes.alias("m"), values.alias("v"))
        good = F.filter(rows, lambda x: F.length(x["v"]) >= least)
        return F.transform(good, lambda x: F.struct(
            x["s"].alias("start"), (x["s"] + x["m"]).alias("end"), F.lit(kind).alias("kind"), F.sha2(x["v"], 256).alias("value")
        )).cast(_SPAN)

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _inside(span: Column, spans: Column) -> Column:
    """Whether one of the spans (ascending, none overlapping) holds a span: the last that starts no later, by binary search."""
    bits = F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int")
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), 32 - bits, bits)

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= F.size(spans)) & (F.try_element_at(spans, to)["start"] <= span["start"]), to).otherwise(at)

    last = F.aggregate(steps, F.lit(0), step)
    return F.coalesce(F.try_element_at(spans, F.greatest(last, F.lit(1)))["end"] >= span["end"], F.lit(False)) & (last > 0)


def secret_candidates(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """One row per input row: row_id, doc_id, owner, the spans of each base kind and bare ones, with the digest of their credential."""
    text = F.col("_text")
    none = F.array().cast(_SPAN)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.col(owner_col).alias("owner"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    kinds = {}
    for kind, (name, (pattern, group, least)) in enumerate(BASE.items()):
        kinds[name] = F.when(text.rlike(SCREEN[name]), _spans(text, LONG.get(name, pattern), group, least, kind)).otherwise(none)
    bare = F.when(text.rlike(BARE), _spans(text, BARE, 0, 12, len(BASE))).otherwise(none)
    return rows.select("row_id", "doc_id", "owner", *[x.alias(name) for name, x in kinds.items()], bare.alias("bare"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """value -> repositories, owners, base_owners, verdict, of values that are a base credential somewhere.

    Repositories and owners hold the value in a base or a bare span; base_owners hold it in a base span. Verdicts:
    example (example_owners or example_repositories, or more), live (else, one base owner) and shared. A repository is
    a document here. Each level combines map-side, so that a value in a third of all rows costs each task one row for
    each repository, then one for each owner.
    """
    values = lambda spans, base: F.transform(F.array_distinct(F.transform(spans, lambda x: x["value"])), lambda x: F.struct(x.alias("value"), F.lit(base).alias("base")))
    each = found.select("owner", "doc_id", F.explode(F.concat(values(F.concat(*BASE), True), values("bare", False))).alias("x")).select("owner", "doc_id", "x.*")
    repositories = each.groupBy("value", "owner", "doc_id").agg(F.max("base").alias("base"))
    owners = repositories.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max("base").alias("base"))
    totals = owners.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"), F.count_if("base").alias("base_owners")).filter("base_owners > 0")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    return totals.withColumn("verdict", F.when(example, "example").when(F.col("base_owners") == 1, "live").otherwise("shared"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*BASE, "copy")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, repositories
    (the most that hold one of the row's base credentials; 0 without any).

    Base spans are those of the three patterns. Added spans (kind copy) are bare tokens outside them whose value is a
    live-looking base credential elsewhere in the corpus; widely copied examples add none. Positions are code points.

    Null text is empty: no spans, digest of the empty string. A null owner is an owner of its own. Repeated rows are
    reported each; they count as one repository. An empty table gives an empty result.
    """
    found = cut(secret_candidates(docs, owner_col))
    verdicts = ownership(found, example_owners)
    outside = F.filter("bare", lambda b: ~(_inside(b, F.col("assign")) | _inside(b, F.col("access")) | _inside(b, F.col("hex"))))
    each = found.select("row_id", F.explode(F.concat(*BASE, outside)).alias("x"))
    copy = F.col("x.kind") == len(BASE)
    judged = each.join(verdicts, F.col("x.value") == F.col("value")).groupBy("row_id").agg(
        F.count_if(~copy & (F.col("verdict") == "live")).alias("n_live"),
        F.count_if(~copy & (F.col("verdict") == "example")).alias("n_example"),
        F.max(F.when(~copy, F.col("repositories"))).alias("repositories"),
        F.collect_list(F.when(copy & (F.col("verdict") == "live"), F.col("x"))).alias("added"),
    )
    by_place = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    out = found.join(judged, "row_id", "left")
    return out.select(
        "doc_id", *[F.size(name).cast("long").alias(f"n_{name}") for name in BASE],
        F.sha2(_joined(by_place(F.concat(*BASE))), 256).alias("base_sha256"),
        _joined(by_place(F.concat(*BASE, F.coalesce("added", F.array().cast(_SPAN))))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("repositories", F.lit(0)).alias("repositories"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(read_documents(spark, sf_dir))

"""Duplicates of normalised items: exact identities, near texts, clusters, assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.filters import likely
from leadloom.operators.graph import connected_components
from leadloom.plans.lineage import cut, emptied, new_table
from leadloom.plans.lineage import stored as parquet_cut

DEDUPLICATOR_VERSION = "deduplicator-v1"
THRESHOLD, WINDOW_HOURS = 0.95, 168
KINDS = ("REPRESENTATIVE", "SOURCE_IDENTITY", "CANONICAL_URL", "NORMALIZED_HASH", "NEAR_TEXT")


def dedup_candidates(normalized: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Normalised items with the source, external id and verticals of their raw items."""
    held = raw.select("raw_item_id", "source_id", "external_id")
    return normalized.join(held, "raw_item_id").join(sources.select("source_id", "verticals"), "source_id")


def observed_at(published: Column, created: Column) -> Column:
    return F.coalesce(published, created)


def exact_edges(items: DataFrame) -> DataFrame:
    """(a, b, kind): each item with the first holder of each identity it shares; a is the earlier one.

    items: id long, observed_at, source_id, external_id, canonical_url, normalized_hash. A key's first holder is found
    by partial aggregation, so a key of a third of all rows costs each task one row.
    """
    edges = None
    for priority, (kind, keys) in enumerate((("SOURCE_IDENTITY", ["source_id", "external_id"]), ("CANONICAL_URL", ["canonical_url"]), ("NORMALIZED_HASH", ["normalized_hash"]))):
        rows = items.filter(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "id", "observed_at")
        first = rows.groupBy(*keys).agg(F.min(F.struct("observed_at", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        found = rows.join(first, keys).select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.lit(priority).alias("priority")).filter("a <> b")
        edges = found if edges is None else edges.unionByName(found)
    kinds = F.array(*[F.lit(k) for k in KINDS[1:4]])
    return edges.groupBy("a", "b").agg(F.min("priority").alias("p")).select("a", "b", F.element_at(kinds, F.col("p") + 1).alias("kind"))


def token_ngrams(text: Column, width: int = 3) -> Column:
    """Distinct runs of `width` tokens (fewer if the text is shorter) of letters and digits, lowered."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def runs(t: Column) -> Column:
        last = F.greatest(F.size(t) - (width - 1), F.lit(1))
        return F.when(F.size(t) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(t, i, width), " ")))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), runs)[0]


def near_text_similarity(a: Column, b: Column) -> Column:
    """Overlap coefficient; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


#: n-grams that a candidate shares with the beginning of the smaller set, where it has so many.
SHARED_PREFIX = 2
#: More n-grams than FEW_GRAMS are shuffled in SLICES parts, by their hashes, one after another.
FEW_GRAMS, SLICES = 4_000_000, 4


def _shared_grams(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, key, m, fresh), and (k, m, fresh, grams): the n-grams that other texts have too, rarest first. m: size of the whole set.

    Texts go by numbers from here on, and each n-gram is shuffled once: its count and its holders come from one exchange.
    """
    hashed = F.transform(token_ngrams(F.col("text")), lambda g: F.xxhash64(g))
    fresh = F.col("fresh") if "fresh" in texts.columns else F.lit(True).alias("fresh")
    number = F.monotonically_increasing_id() * 2 + F.col("fresh").cast("long")  # the last bit tells whether it is fresh
    rows = texts.select("key", hashed.alias("grams"), fresh).withColumn("m", F.size("grams")).filter("m > 0")
    spark = texts.sparkSession
    paths = [new_table(spark, "grams")]
    sets = parquet_cut(rows.withColumn("k", number), "grams", paths[0])
    names = parquet_cut(sets.drop("grams"), "names")
    many = (names.agg(F.sum("m")).first()[0] or 0) > FEW_GRAMS
    held = None
    for i in range(SLICES if many else 1):  # the shuffles of a slice leave the disk before the next one's are made
        grams = F.filter("grams", lambda g: F.pmod(g, F.lit(SLICES)) == i) if many else F.col("grams")
        every = sets.select("k", F.explode(grams).alias("g")).filter("g is not null and k is not null").repartition("g")  # both readers need these, so they share the exchange
        seen = every.groupBy("g").agg(F.count("*").alias("df"), F.min("k").alias("low"), F.max("k").alias("high"), F.max(F.col("k").bitwiseAND(1)).alias("any"))
        some = every.join(seen.filter("low < high and any = 1").select("g", "df"), "g")
        if many:
            paths.append(new_table(spark, "held"))
            some = parquet_cut(some, "held", paths[-1])
        held = some if held is None else held.unionByName(some)
    if many:
        emptied(spark, paths.pop(0))
    lists = held.repartition("k").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("x")).select("k", F.col("x.g").alias("grams"))
    own = parquet_cut(lists.join(names.select("k", "m", "fresh"), "k"), "shared")
    emptied(spark, *paths)
    return names, own


def near_text_pairs(texts: DataFrame, threshold: float = THRESHOLD, places: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b, similarity) of distinct texts with overlap coefficient >= threshold. texts: key, text, and maybe fresh.

    places (key, vertical, bin): only texts that share a vertical in the same or a neighbouring bin are compared.
    fresh (boolean): only pairs with at least one fresh text are looked for.
    Of the smaller set's rarest m - ceil(t m) + l n-grams, l must be among those of the larger one (l: SHARED_PREFIX, or
    ceil(t m) if that is less), in a vertical and a bin of both. N-grams of one text alone count, but are not looked up.
    Sets are 64-bit hashes. A pair is verified once, where the larger set is: only the smaller one travels to it.
    """
    names, own = _shared_grams(texts)
    need = F.ceil(F.lit(threshold) * F.col("m") - 1e-9)
    least = F.least(F.lit(SHARED_PREFIX), need)
    length = F.least(F.size("grams"), F.greatest(F.lit(0), F.size("grams") - need + least)).cast("int")
    probe = own.select("k", "m", "fresh", least.alias("least"), F.explode(F.slice("grams", 1, length)).alias("g"))
    index = own.select(F.col("k").alias("b"), F.col("m").alias("m_b"), F.col("fresh").alias("fresh_b"), F.explode("grams").alias("g"))
    index = likely(index, probe.select("g"), "g")  # others meet nothing
    meet = ["g"]
    if places is not None:
        placed = cut(places.join(names.select("key", "k"), "key").select("k", "vertical", "bin"))
        index = index.join(placed.withColumnRenamed("k", "b"), "b")
        near_bins = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))
        probe = probe.join(placed.withColumn("bin", near_bins).distinct(), "k")
        meet = ["g", "vertical", "bin"]
    order = F.struct(F.col("m"), F.col("k")) < F.struct(F.col("m_b").alias("m"), F.col("b").alias("k"))
    met = probe.join(index, meet).filter(order & (F.col("fresh") | F.col("fresh_b"))).groupBy(F.col("k").alias("a"), "b").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    pairs = parquet_cut(met.filter("n >= least").select("a", "b"), "pairs")
    left = likely(own.select(F.col("k").alias("a"), F.col("m").alias("m_a"), F.col("grams").alias("grams_a")), pairs.select("a"), "a")
    right = likely(own.select(F.col("k").alias("b"), F.col("grams").alias("grams_b")), pairs.select("b"), "b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size(F.array_intersect("grams_a", "grams_b")) / F.col("m_a")).alias("similarity"))
    near = both.filter(F.col("similarity") >= threshold)
    name = lambda x: names.select(F.col("k").alias(x), F.col("key").alias(f"key_{x}"))
    return near.join(name("a"), "a").join(name("b"), "b").select("key_a", "key_b", "similarity")


def near_edges(items: DataFrame, threshold: float = THRESHOLD, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """(a, b, similarity): each item with the earliest item of each near text, within the window and a shared vertical.

    items: id long, observed_at, verticals, normalized_hash, text. Copies of one text are linked by their hash already,
    so the earliest partner keeps all clusters. Texts, then items, meet by vertical and by window or a neighbouring one.
    """
    span = window_hours * 3600
    placed = items.select("id", F.col("normalized_hash").alias("key"), F.unix_micros("observed_at").alias("at"), F.explode(F.array_distinct("verticals")).alias("v"))
    placed = placed.withColumn("bin", F.floor(F.col("at") / F.lit(span * 1_000_000)))
    texts = items.groupBy(F.col("normalized_hash").alias("key")).agg(F.first("text").alias("text"))
    near = cut(near_text_pairs(texts, threshold, placed.select("key", F.col("v").alias("vertical"), "bin").distinct()))
    both = near.unionByName(near.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "similarity"))
    one = placed.join(both.withColumnRenamed("key_a", "key"), "key").withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    two = placed.select(F.col("id").alias("id_b"), F.col("key").alias("key_b"), F.col("at").alias("at_b"), "v", "bin")
    met = one.join(two, ["key_b", "v", "bin"]).filter(F.abs(F.col("at") - F.col("at_b")) <= span * 1_000_000)
    best = met.groupBy("id", "key_b").agg(F.min(F.struct("at_b", "id_b")).alias("p"), F.first("similarity").alias("similarity"), F.first("at").alias("at"))
    first = F.struct(F.col("p.at_b").alias("t"), F.col("p.id_b").alias("i")) < F.struct(F.col("at").alias("t"), F.col("id").alias("i"))
    a, b = F.when(first, F.col("p.id_b")).otherwise(F.col("id")), F.when(first, F.col("id")).otherwise(F.col("p.id_b"))
    return best.select(a.alias("a"), b.alias("b"), "similarity").distinct()


def pairs_in_window(items: DataFrame, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """By vertical the number of pairs of items within the window, by prefix sums instead of pairs. items: vertical, observed_at.

    With C(t) the number of items before time t, an item at t has C(t) - C(t - window) partners before it; so each time is
    asked for twice in one order of all times. That order is dealt to range parts: a part sums its own times, and the
    totals of earlier parts are added, so a vertical or a single busy hour is spread over as many tasks as it needs.
    """
    span = window_hours * 3_600_000
    times = items.filter("observed_at is not null").groupBy("vertical", F.unix_millis("observed_at").alias("at")).agg(F.count("*").alias("k"))
    asked = F.array(F.struct(F.col("at").alias("t"), F.col("k").alias("own"), F.col("k").alias("sign")), F.struct((F.col("at") - span).alias("t"), F.lit(0).cast("long").alias("own"), (-F.col("k")).alias("sign")))
    rows = times.select("vertical", F.explode(asked).alias("x")).select("vertical", "x.*")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(rows.repartitionByRange(n, "vertical", "t").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("vertical", "part").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("vertical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("before", F.coalesce(F.sum("own").over(inside), F.lit(0))).groupBy("vertical", "part").agg(
        F.sum(F.col("sign") * F.col("before")).alias("inside"), F.sum("sign").alias("signs"), F.sum("own").alias("total"), F.sum(F.expr("own * (own - 1) div 2")).alias("equal")
    )
    offset = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    return own.withColumn("pairs", F.col("inside") + F.col("equal") + F.col("signs") * offset).groupBy("vertical").agg(F.sum("pairs").cast("long").alias("pairs"))


def duplicate_clusters(edges: DataFrame) -> DataFrame:
    """(node, component) of all edges."""
    return connected_components(edges.select("a", "b"))


def cluster_representatives(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(component, representative_id): the earliest member by (observed_at, id)."""
    return items.join(clusters, items["id"] == clusters["node"]).groupBy("component").agg(F.min(F.struct("observed_at", "id")).alias("m")).select("component", F.col("m.id").alias("representative_id"))


def best_edge(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Of each item its best edge: kind, then similarity, then the earlier place of the pair, then the earlier partner.

    edges: a, b, kind, similarity (a is the earlier item).
    """
    place = items.select("id", F.struct("observed_at", "id").alias("place"))
    both = edges.select(F.col("b").alias("id"), F.col("a").alias("partner"), "a", "kind", "similarity").unionByName(
        edges.select(F.col("a").alias("id"), F.col("b").alias("partner"), "a", "kind", "similarity")
    )
    both = both.join(place.select(F.col("id").alias("a"), F.col("place").alias("first_place")), "a").join(place.select(F.col("id").alias("partner"), F.col("place").alias("partner_place")), "partner")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = Window.partitionBy("id").orderBy(rank, F.desc("similarity"), "first_place", "partner_place")
    return both.withColumn("r", F.row_number().over(order)).filter("r = 1").select("id", F.col("partner").alias("matched_to_id"), F.col("kind").alias("match_kind"), "similarity")


def dedup_assignments(items: DataFrame, threshold: float = THRESHOLD, window_hours: int = WINDOW_HOURS, near: bool = True) -> DataFrame:
    """One row per item: representative_id, matched_to_id, match_kind, similarity, time_distance_hours.

    Exact kinds have similarity 1; a representative is matched to itself with similarity 1 and distance 0.
    """
    exact = cut(exact_edges(items).withColumn("similarity", F.lit(1.0)))  # cut, as clusters below: one plan of all exchanges would cost the driver a thread for each
    edges = exact
    if near:
        close = near_edges(items, threshold, window_hours).withColumn("kind", F.lit("NEAR_TEXT")).select("a", "b", "kind", "similarity")
        edges = exact.select("a", "b", "kind", "similarity").unionByName(close.join(exact.select("a", "b"), ["a", "b"], "left_anti"))
    edges = cut(edges.select("a", "b", "kind", "similarity"))
    clusters = cut(duplicate_clusters(edges))
    heads = cluster_representatives(items, clusters)
    member = clusters.join(heads, "component").select(F.col("node").alias("id"), "representative_id")
    base = items.select("id", "observed_at")
    out = base.join(member, "id", "left").join(best_edge(edges, items), "id", "left")
    is_head = F.col("representative_id").isNull() | (F.col("representative_id") == F.col("id"))
    out = out.select(
        "id", F.coalesce("representative_id", "id").alias("representative_id"), F.when(is_head, F.col("id")).otherwise(F.col("matched_to_id")).alias("matched_to_id"),
        F.when(is_head, F.lit(KINDS[0])).otherwise(F.col("match_kind")).alias("match_kind"), F.when(is_head, 1.0).otherwise(F.col("similarity")).alias("similarity"), "observed_at",
    )
    partner = base.select(F.col("id").alias("matched_to_id"), F.col("observed_at").alias("_at"))
    hours = F.abs(F.unix_micros("observed_at") - F.unix_micros("_at")) / 3.6e9
    return out.join(partner, "matched_to_id").select(
        "id", "representative_id", "matched_to_id", "match_kind", "similarity", F.when(F.col("match_kind") == KINDS[0], 0.0).otherwise(hours).alias("time_distance_hours")
    )


def _touched(new: DataFrame, stored: DataFrame, threshold: float, window_hours: int, near: bool) -> DataFrame:
    """Ids of stored items that share an identity with a new one, or are near one in a shared vertical and about its time."""
    found = None
    for keys in (["source_id", "external_id"], ["canonical_url"], ["normalized_hash"]):
        ids = stored.join(new.select(*keys).dropna().distinct(), keys, "left_semi").select("id")
        found = ids if found is None else found.unionByName(ids)
    if near:
        span = window_hours * 3_600_000_000
        place = lambda df: df.select("id", F.col("normalized_hash").alias("key"), F.explode(F.array_distinct("verticals")).alias("vertical"), F.floor(F.unix_micros("observed_at") / F.lit(span)).alias("bin"))
        fresh = cut(place(new))
        around = fresh.select("vertical", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct()
        old = cut(place(stored).join(around, ["vertical", "bin"], "left_semi"))
        both = fresh.unionByName(old)
        text = lambda df, fresh: df.select(F.col("normalized_hash").alias("key"), "text", F.lit(fresh).alias("fresh"))
        texts = text(new, True).unionByName(text(stored.join(old.select("id"), "id", "left_semi"), False))
        texts = texts.groupBy("key").agg(F.first("text").alias("text"), F.bool_or("fresh").alias("fresh"))
        pairs = near_text_pairs(texts, threshold, both.select("key", "vertical", "bin").distinct())
        keys = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
        found = found.unionByName(old.join(keys, "key", "left_semi").select("id"))
    return found.distinct()


def dedup_increment(new: DataFrame, stored: DataFrame, assignments: DataFrame, threshold: float = THRESHOLD, window_hours: int = WINDOW_HOURS, near: bool = True) -> DataFrame:
    """Assignments of new items and of all members of the stored clusters that they touch; together with the other stored ones those of dedup_assignments over all items.

    A cluster holds all holders of its members' identities and all texts near to them, so clusters that no new item
    touches keep their edges, and those that one touches are made anew from their members alone. A new item that joins
    several clusters makes them one, whose representative is the earliest member of all; an earlier item becomes the
    representative. Only items of the same time and vertical are compared as texts. new, stored: items as in
    dedup_assignments, without common ids; assignments: id, representative_id of the stored items.
    """
    new = parquet_cut(new, "new")
    touched = _touched(new, stored, threshold, window_hours, near)
    heads = assignments.join(touched, "id", "left_semi").select("representative_id").distinct()
    members = assignments.join(heads, "representative_id", "left_semi").select("id")
    subset = parquet_cut(stored.join(members, "id", "left_semi").select(*new.columns).unionByName(new), "subset")
    return dedup_assignments(subset, threshold, window_hours, near)


def dedup_metrics(assignments: DataFrame) -> DataFrame:
    head, near = F.col("match_kind") == KINDS[0], F.col("match_kind") == "NEAR_TEXT"
    return assignments.agg(
        F.count("*").alias("input_items"), F.count_if(head).alias("clusters"), F.count_if(~head).alias("duplicates"), F.count_if(~head & ~near).alias("exact_duplicates"), F.count_if(near).alias("near_duplicates")
    )


def check_dedup_coverage(candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """Violations (problem, id): repeated or missing items, assignments or references outside the batch, no vertical."""
    ids, given = candidates.select("id"), assignments.select("id")
    outside = lambda c: assignments.select(F.col(c).alias("id")).distinct().join(ids, "id", "left_anti")
    parts = {
        "REPEATED_CANDIDATE": ids.groupBy("id").count().filter("count > 1").select("id"),
        "REPEATED_ASSIGNMENT": given.groupBy("id").count().filter("count > 1").select("id"),
        "MISSING_ASSIGNMENT": ids.exceptAll(given), "UNKNOWN_ITEM": given.exceptAll(ids),
        "OUTSIDE_REFERENCE": outside("matched_to_id").union(outside("representative_id")).distinct(),
        "NO_VERTICAL": candidates.filter(F.size("verticals") == 0).select("id"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("problem"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out

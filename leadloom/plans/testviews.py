"""Maps the driver's tables to the model's tables. For queries and tests only; SQL has the same mappings as CTEs."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.rules import Rule

#: Rules over the invented Latin prose.
LATIN_RULES = [
    Rule("construction", "vertical.construction.tion", r" tion "), Rule("construction", "vertical.construction.ment", r" ment "), Rule("construction", "vertical.construction.keit", r" keit "),
    Rule("horeca", "vertical.horeca.re", r" re "), Rule("horeca", "vertical.horeca.eau", r" eau "), Rule("horeca", "vertical.horeca.der", r" der "),
    Rule("opportunity", "opportunity.tender", r" the "), Rule("opportunity", "opportunity.procurement", r" que "), Rule("opportunity", "opportunity.opening", r" die "),
    Rule("advertisement", "advertisement.explicit", r"license"), Rule("advertisement", "advertisement.discount", r" she "), Rule("advertisement", "advertisement.promotion", r" st "),
    Rule("irrelevance", "irrelevance.notice", r"stupid"),
]


def ascii_upper(text: Column) -> Column:
    """Capitals of a to z only, which all engines make alike."""
    return F.translate(text, ascii_lowercase, ascii_uppercase)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("source_id"), F.concat(F.lit("name "), "source").alias("name"), n.alias("n"), F.lit(True).alias("enabled"), F.lit("RSS").alias("type"),
            F.array(F.element_at(F.array(*[F.lit(v) for v in ("CONSTRUCTION", "HORECA", "OTHER")]), n % 3 + 1)).alias("verticals"),
            (35 + n * 7 % 60).cast("double").alias("reliability"), F.when(n % 10 == 9, "REVIEW_REQUIRED").otherwise("OPEN_DATA").alias("rights"), (n % 10 != 9).alias("ai_allowed"),
        )

    @property
    def raw(self) -> DataFrame:
        i = F.col("doc_id")
        at = F.timestamp_micros(F.lit(1767225600000000) + i * 600000000)
        return self.table("documents").select(
            i.alias("raw_item_id"), i.alias("position"), F.col("source").alias("source_id"), F.when(i % 10 != 0, F.concat(F.lit("ext-"), i.cast("string"))).alias("external_id"),
            F.concat(F.lit("https://x.test/"), i.cast("string")).alias("url"), at.alias("published_at"), at.alias("received_at"), F.col("text").alias("raw_text"),
            F.lit(None).cast("string").alias("raw_payload"), F.sha2("text", 256).alias("content_hash"),
        )

    @property
    def items(self) -> DataFrame:
        """Normalised items with some shared external ids and URLs."""
        i = F.col("raw_item_id")
        return self.raw.select(
            i.alias("id"), "raw_item_id", F.col("published_at").alias("observed_at"), "source_id", F.when(i % 10 != 0, F.concat(F.lit("e"), (i % 331).cast("string"))).alias("external_id"),
            F.when(i % 3 == 0, F.concat(F.lit("u"), (i % 501).cast("string"))).alias("canonical_url"), F.col("content_hash").alias("normalized_hash"), F.col("raw_text").alias("text"),
        ).join(self.sources.select("source_id", "verticals", "ai_allowed", "rights", "enabled"), "source_id")

    @property
    def recommendations(self) -> DataFrame:
        """orders as signals and recommendations of users."""
        k = F.col("o_orderkey")
        score = (F.round(F.col("o_totalprice") * 100).cast("long") % 10001) / 100.0
        return self.table("orders").select(
            k.alias("id"), k.alias("analysis_id"), (k % 997).alias("signal_id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("profile_id"), (k % 2 + 1).cast("int").alias("profile_revision"),
            score.alias("total_score"), F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 55, "MEDIUM").when(score >= 40, "LOW").otherwise("IGNORE").alias("band"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "CANDIDATE").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("ARCHIVED").alias("status"),
        )

    @property
    def signals(self) -> DataFrame:
        return self.recommendations.select(F.col("id").alias("signal_id"), "category", "created_at", "status", F.lit("classifier-v2").alias("classifier_version"))

    @property
    def profiles(self) -> DataFrame:
        c = F.col("c_custkey")
        one = lambda v: F.array(F.lit(v))
        return self.table("customer").withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            c.alias("id"), c.alias("user_id"), "revision", F.array(F.when(c % 2 == 0, "CONSTRUCTION").otherwise("HORECA")).alias("verticals"), F.array(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("regions"),
            F.array(F.col("c_mktsegment")).alias("keywords"), F.array(F.when(c % 7 == 0, F.lower("c_mktsegment")).otherwise("none")).alias("excluded_keywords"),
            one("tender").alias("interested_event_types"), F.array(F.when(c % 11 == 0, "Tender").otherwise("x")).alias("ignored_event_types"),
            F.col("c_acctbal").alias("project_value_minimum"), (F.lit(5000.0) + F.col("revision") * 100).alias("project_value_maximum"), F.when(c % 5 != 0, "EUR").alias("currency"),
        )

    @property
    def feedback(self) -> DataFrame:
        e = F.col("event_type")
        action = F.when(e == "click", "USEFUL").when(e == "error", "NOT_USEFUL").when(e == "view", "ALREADY_KNOWN").when(e == "signup", "SAVED").otherwise("ACTED")
        return self.table("events").select(
            F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("recommendation_id"), action.alias("action"),
            F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("delivery_id"), F.col("ts").alias("created_at"),
        )

    @property
    def deliveries(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            i.alias("id"), (F.col("user_id") + F.when(i % 50 == 0, 1).otherwise(0)).alias("user_id"), F.get_json_object("props", "$.k").cast("long").alias("recommendation_id"), F.lit("TELEGRAM").alias("channel"),
            F.concat(F.lit("k"), (i % 4000).cast("string")).alias("idempotency_key"), F.when(i % 4 == 0, "PENDING").when(i % 4 == 1, "SENT").when(i % 4 == 2, "FAILED").otherwise("SENT").alias("status"),
            F.when(i % 4 == 1, i.cast("string")).alias("provider_message_id"), F.when(i % 4 == 2, "X").alias("failure_code"), F.col("ts").alias("updated_at"), F.when(i % 2 == 0, "NEW").otherwise("SAVED").alias("kind"), (i % 9 == 0).alias("reused"),
        )

    @property
    def gold(self) -> DataFrame:
        q = F.col("quality") == 1
        quote = F.regexp_extract("text", r"^[^.\n]*", 0)
        return self.table("labels").join(self.table("documents"), "doc_id").select(
            F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 < 2, "CALIBRATION").otherwise("HOLDOUT").alias("split"), F.concat(F.lit("u"), (F.col("doc_id") % 390).cast("string")).alias("url"), "text",
            F.col("source").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "CONSTRUCTION").otherwise("HORECA").alias("vertical"), q.alias("relevant"), F.when(q, "PROJECT").otherwise("OTHER").alias("category"),
            F.when(q, "opening notice").otherwise("irrelevant_notice").alias("event_type"), F.when(q | (F.col("toxic") == 1), "CONTACT").otherwise("IGNORE").alias("action"), F.when(q, 30 + F.col("doc_id") % 60).otherwise(20).alias("importance"),
            F.array(F.struct(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"), quote.alias("statement"), quote.alias("evidenceQuote"))).alias("facts"),
        )

    @property
    def predictions(self) -> DataFrame:
        i = F.col("id")
        status = F.when(i % 17 == 0, "FAILED").when(i % 19 == 0, "THROWN").otherwise("SUCCEEDED")
        return self.gold.filter(i % 23 != 0).select(
            "id", status.alias("status"), F.when(F.length("text") % 3 == 0, F.when(i % 2 == 0, "IRRELEVANT_NOTICE ").otherwise("irrelevant_notice")).otherwise("Opening  Notice").alias("event_type"), (i % 13 != 0).alias("valid"),
            F.when((status != "SUCCEEDED") & (i % 4 != 3), F.concat(F.lit("E"), (i % 2).cast("string"))).alias("failure_code"),
            F.array(
                F.struct(F.lit("p1").alias("id"), F.array("source_id").alias("sourceIds"), F.concat(F.col("facts")[0]["statement"], F.when(i % 5 == 0, " and what no text says").otherwise("")).alias("statement")),
                F.struct(F.lit("p2").alias("id"), F.array(F.when(i % 7 == 0, "elsewhere").otherwise(F.col("source_id"))).alias("sourceIds"), ascii_upper(F.left("text", F.lit(20))).alias("statement")),
            ).alias("facts"),
        )

    @property
    def judged(self) -> DataFrame:
        from leadloom.operators.evals import prediction_validity

        return prediction_validity(self.gold, self.predictions)

    @property
    def runs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.lit("p").alias("prompt_version"), F.lit("ALL").alias("split"), F.col("l_quantity").alias("latency_ms"),
            F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"),
        )

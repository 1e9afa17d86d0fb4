"""Test inputs derived from the driver tables; the DuckDB twins are in catalog/fixture_sql."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.hlc import stamp
from .session import SETTINGS
from .plans.skew import attach, spread
from .plans.ordered import Running, cut, number_rows, running

NOW_MS = 1_706_659_200_000
NODES = ("d0", "d1", "d2")
VAULT_KEYS = ["vault_id", "file_id"]


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


class Inputs:
    """Lazily built inputs for one (session, folder)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        sc = spark.sparkContext
        if sc.master.startswith("local"):
            spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))

    def kept(self, name: str, build) -> DataFrame:
        """An input several queries share, kept in executor memory and disk once computed."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _KEPT:
            _KEPT[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return _KEPT[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        e = self.table("events")
        return (e.withColumn("ts", F.col("ts").cast("timestamp"))
                .withColumn("ms", F.unix_millis("ts")))

    # write log -----------------------------------------------------------------------
    def w(self) -> DataFrame:
        """Write log: one row per put, numbered per file and per vault."""
        return self.kept("w", self._w)

    def _w(self) -> DataFrame:
        e = self.events().withColumn("vault_id", F.concat(F.lit("v"), F.col("user_id") % 4))
        e = e.withColumn("file_id", F.concat(F.lit("f"), F.col("user_id")))
        e = e.withColumn("node", F.concat(F.lit("d"), F.col("event_id") % 3))
        raw, piece = e, cut(e, "ms")
        same_ms = Window.partitionBy(*VAULT_KEYS, "ms").orderBy("event_id")
        e = e.withColumn("cnt", F.row_number().over(same_ms).cast("long") - 1)
        e = number_rows(e, VAULT_KEYS, ["ts", "event_id"], piece, "rn", raw)
        e = number_rows(e, ["vault_id"], ["ts", "event_id"], piece, "server_seq", raw)
        gone = F.col("event_type") == "error"
        return e.select(
            "event_id", "vault_id", "file_id", "node", "ms", "cnt", "rn", "server_seq",
            ((F.col("event_id") * 7) % 5).alias("lag"), gone.alias("tombstone"),
            F.when(gone, F.lit("")).otherwise(F.sha2("props", 256)).alias("blob_ref"),
            F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"),
            F.round(F.col("value") * 100).cast("long").alias("size_bytes"))

    def c(self) -> DataFrame:
        """Causal contexts as rows, built from per-node running maxima (no per-file pairs)."""
        return self.kept("c", self._c)

    def _c(self) -> DataFrame:
        w = self.w()
        seen = running(
            w.select(*VAULT_KEYS, "rn", "ms", "cnt", "node"), VAULT_KEYS, ["rn"],
            cut(w, "ms"),
            [Running(f"h_{n}", "max", F.when(F.col("node") == n, stamp())) for n in NODES])
        tops = seen.select(
            *VAULT_KEYS, F.col("rn").alias("upto"),
            F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"h_{n}").alias("h"))
                      for n in NODES]).alias("tops"))
        views = F.explode(F.array(
            F.struct(F.lit(True).alias("own"), (F.col("rn") - 1).alias("upto")),
            F.struct(F.lit(False).alias("own"), (F.col("rn") - F.col("lag") - 1).alias("upto"))))
        asks = (w.select("event_id", *VAULT_KEYS, F.col("node").alias("writer"),
                         views.alias("v"))
                .select("event_id", *VAULT_KEYS, "writer", "v.own", "v.upto")
                .where("upto >= 1"))
        return (asks.join(tops, [*VAULT_KEYS, "upto"])
                .select("event_id", *VAULT_KEYS, "writer", "own", F.inline("tops"))
                .where("h is not null and own = (node = writer)")
                .select("event_id", *VAULT_KEYS, "node", "h"))

    def arr(self) -> DataFrame:
        """The write log with out-of-order arrival numbers per file."""
        return self.kept("arr", self._arr)

    def _arr(self) -> DataFrame:
        w = self.w().withColumn("_late", F.col("rn") + (F.col("event_id") * 13) % 11)
        return number_rows(w, VAULT_KEYS, ["_late", "rn"], cut(w, "_late"), "arrival").drop("_late")

    def refs(self) -> DataFrame:
        """Every blob a write references: one manifest and two chunks."""
        w = self.w().where("not tombstone")
        return w.select("event_id", *VAULT_KEYS, F.explode(F.array(
            F.col("blob_ref"), F.concat(F.lit("c"), F.col("k")),
            F.concat(F.lit("c"), (F.col("k") * 7) % 100))).alias("ref"))

    def registers(self) -> DataFrame:
        """Survivors of the lattice join with paths and chunk lists."""
        from .operators.causal import register_join

        return self.kept("registers", lambda: with_state_columns(register_join(self.w(), self.c())))

    # heads ---------------------------------------------------------------------------
    def head_reports(self) -> DataFrame:
        w = self.w()
        stale = (F.col("vault_id") == "v3") & (F.col("node") == "d2")
        return w.select(
            "vault_id", F.col("node").alias("device"), F.col("event_id").alias("arrival"),
            F.greatest(F.col("server_seq") - F.col("event_id") % 40, F.lit(0)).alias("head_seq"),
            F.when(stale, F.col("ms") - 8640000000).otherwise(F.col("ms")).alias("updated_ms"))

    def head_ctx(self) -> DataFrame:
        """Frontier rows of each device: per author, the newest write under its head."""
        heads = self.head_reports().groupBy("vault_id", "device").agg(
            F.max("head_seq").alias("head_seq"))
        heads = heads.where("not (vault_id = 'v2' and device = 'd1')")
        w = self.w().select("vault_id", "server_seq", "node", stamp().alias("h"), "ms")
        marks = heads.select(
            "vault_id", F.col("head_seq").alias("server_seq"), "device",
            F.lit(None).cast("string").alias("node"),
            F.lit(None).cast("struct<ms:bigint,cnt:bigint>").alias("h"), F.lit(1).alias("is_head"))
        rows = w.drop("ms").withColumn("device", F.lit(None).cast("string")).withColumn(
            "is_head", F.lit(0)).unionByName(marks)
        seen = running(rows, ["vault_id"], ["server_seq", "is_head"],
                       cut(rows, "server_seq"),
                       [Running(f"h_{n}", "max", F.when(F.col("node") == n, F.col("h")))
                        for n in NODES])
        return (seen.where("is_head = 1").select("vault_id", "device", F.inline(F.array(
            *[F.struct(F.lit(n).alias("node"), F.col(f"h_{n}").alias("h")) for n in NODES])))
            .where("h is not null"))

    def history(self) -> DataFrame:
        op = (F.when(F.col("tombstone"), "delete").when(F.col("rn") == 1, "create")
              .otherwise("modify"))
        return self.w().select(
            "event_id", *VAULT_KEYS, "node", "ms", "cnt", "server_seq",
            F.col("ms").alias("created_ms"), "blob_ref", "k", "tombstone", op.alias("op"))

    def blobs(self) -> DataFrame:
        w = self.table("events").select(
            F.sha2("props", 256).alias("sha"),
            F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
        chunk = F.concat(F.lit("c"), F.col("k"))

        def part(cond: str, col, store: str) -> DataFrame:
            return w.where(cond).select(col.alias("blob_id"), F.lit(store).alias("store")).distinct()

        strangers = self.spark.range(20).select(
            F.concat(F.lit("x"), F.col("id")).alias("blob_id"), F.lit("local").alias("store"))
        return (part("k % 10 <> 3", chunk, "remote")
                .unionByName(part("k % 10 <> 4", F.col("sha"), "remote"))
                .unionByName(part("k % 3 <> 0", chunk, "local")).unionByName(strangers))

    def vault_blobs(self) -> DataFrame:
        """The blobs of each vault: what one vault lacks another may hold."""
        w = self.w().select("vault_id", "blob_ref", "k", (
            F.col("k") + F.substring("vault_id", 2, 9).cast("long")).alias("n"))
        chunk = F.concat(F.lit("c"), F.col("k"))

        def part(cond: str, col, store: str) -> DataFrame:
            return w.where(cond).select("vault_id", col.alias("blob_id"), F.lit(store).alias("store")).distinct()

        strangers = self.spark.range(20).select(
            F.concat(F.lit("v"), F.col("id") % 4).alias("vault_id"),
            F.concat(F.lit("x"), F.col("id")).alias("blob_id"), F.lit("local").alias("store"))
        return (part("n % 10 <> 3", chunk, "remote")
                .unionByName(part("n % 10 <> 4 and blob_ref <> ''", F.col("blob_ref"), "remote"))
                .unionByName(part("n % 3 <> 0", chunk, "local")).unionByName(strangers))

    def sync_base(self) -> DataFrame:
        return (self.w().where("rn <= 40 and not tombstone")
                .where(F.substring("file_id", 2, 20).cast("long") % 3 != 0)
                .groupBy(*VAULT_KEYS).agg(F.max_by("blob_ref", "rn").alias("blob_ref")))

    # snapshots and text --------------------------------------------------------------
    def snapshot(self) -> DataFrame:
        d = self.table("documents")
        ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".png", ".txt", "", ".PDF")]),
                           (F.col("doc_id") % 5 + 1).cast("int"))
        return d.select(
            F.concat(F.when(F.col("doc_id") % 50 == 0, ".trash/").otherwise(""), "source",
                     F.lit("/"), F.col("doc_id"), ext).alias("path"),
            (F.col("doc_id") * 1000).alias("mtime"),
            F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"),
            F.sha2("text", 256).alias("hash"))

    def prior(self) -> DataFrame:
        s = self.snapshot().where("mtime % 4000 <> 0")
        known = s.select(
            "path",
            F.when(F.col("mtime") % 3000 == 0, F.sha2(F.concat("content", F.lit("x")), 256))
            .otherwise(F.col("hash")).alias("chunk"),
            (F.col("size") + F.when(F.col("mtime") % 7000 == 0, 1).otherwise(0)).alias("size_bytes"),
            (F.col("mtime") % 11000 == 0).alias("tombstone"))
        i = F.col("id")
        gone = self.spark.range(50).select(
            F.concat(F.lit("gone/"), i, F.lit(".md")).alias("path"),
            F.concat(F.lit("c"), i).alias("chunk"), i.alias("size_bytes"),
            F.lit(False).alias("tombstone"))
        return known.unionByName(gone)

    def versions(self) -> DataFrame:
        """Two divergent texts per conversation, one per side."""
        t = self.table("conversations").withColumn(
            "version", F.when(F.col("role") == "assistant", "A").otherwise("B"))
        return t.groupBy(F.col("conv_id").alias("file_id"), "version").agg(
            F.expr("listagg(text, '\n') within group (order by turn)").alias("body"))

    def fixed_chunks(self) -> DataFrame:
        d = spread(self.table("documents").select("doc_id", "text"), "doc_id")
        d = d.select("doc_id", "text", F.explode(F.sequence(
            F.lit(0), F.expr("cast((length(text) + 255) div 256 as int) - 1"))).alias("ord"))
        piece = F.substr("text", F.col("ord") * 256 + 1, F.lit(256))
        d = d.select("doc_id", F.col("ord").cast("long").alias("ord"), piece.alias("piece"))
        return d.withColumn("hash", F.sha2("piece", 256))

    def dots(self) -> DataFrame:
        return self.table("documents").select(
            F.expr("doc_id div 2").alias("file_id"), (F.col("doc_id") % 2).alias("version"),
            F.posexplode(F.split("text", "")).alias("i", "val")).select(
            "file_id", "version", (F.col("i") + 1).cast("long").alias("dot"), "val")

    # settings ------------------------------------------------------------------------
    def leaves(self) -> DataFrame:
        return self.events().select(
            F.concat(F.lit("u"), F.col("user_id")).alias("doc"), F.col("event_type").alias("path"),
            F.col("props").alias("val"), (F.col("value") >= 10).alias("present"), "ts", "ms",
            "event_id", F.concat(F.lit("d"), F.col("event_id") % 3).alias("node"))

    def orset_adds(self) -> DataFrame:
        return self.table("events").where("event_id % 3 <> 0").select(
            F.concat(F.lit("s"), F.col("user_id") % 50).alias("sid"),
            F.col("event_type").alias("elem"), F.col("event_id").alias("dot"))

    def orset_removed(self) -> DataFrame:
        """Dots some removal has seen. Only the newest removal per element matters."""
        last = self.table("events").where("event_id % 3 = 0").groupBy(
            F.concat(F.lit("s"), F.col("user_id") % 50).alias("sid"),
            F.col("event_type").alias("elem")).agg(F.max("event_id").alias("last"))
        return attach(self.orset_adds(), last, ["sid", "elem"]).where(
            "dot < last - 2").select("sid", "elem", "dot").distinct()

    # accounts ------------------------------------------------------------------------
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_custkey") % 100 == 0, "admin").otherwise("user").alias("role"),
            "c_nationkey", "c_mktsegment")

    def plans(self) -> DataFrame:
        schema = ("plan_id string, amount_kopecks bigint, period_days int, managed boolean, "
                  "external boolean, max_vaults int, max_file bigint, quota bigint, "
                  "acquisition string")
        return self.spark.createDataFrame(PLANS, schema)

    def subs(self) -> DataFrame:
        p = self.plans().select("plan_id", "period_days")
        o = self.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        j = o.join(p, o.o_orderpriority == p.plan_id)
        return j.select(
            F.col("o_orderkey").alias("sub_id"), F.col("o_custkey").alias("user_id"), "plan_id",
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started"),
            F.expr("o_orderdate + make_dt_interval(period_days)").alias("ends"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_kopecks"))

    def codes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("CODE-"), k).alias("code"),
            F.when(k % 2 == 0, F.lit(5) + F.col("p_size")).alias("percent"),
            F.when(k % 2 == 1, F.round(F.col("p_retailprice") * 100).cast("long")).alias("kopecks"),
            F.when(k % 4 == 0, 500000).alias("max_discount"),
            F.when(k % 3 == 0, 2000000).alias("min_order"),
            F.when(k % 5 == 0, "3-MEDIUM").alias("only_plan"),
            F.when(k % 97 == 0, k % 1500).alias("only_user"),
            F.when(k % 7 == 0, 20).alias("max_redemptions"), (1 + k % 2).alias("max_per_user"),
            (k % 13 != 0).alias("is_active"), F.col("p_brand").alias("campaign"),
            F.when(k % 6 == 0, F.lit("1997-01-01").cast("timestamp")).alias("starts_at"),
            F.when(k % 8 == 0, F.lit("2000-06-01").cast("timestamp")).alias("expires_at"))

    def checkouts(self) -> DataFrame:
        """Checkout attempts, numbered over the whole table by ship date."""
        return self.kept("checkouts", self._checkouts)

    def _checkouts(self) -> DataFrame:
        li = self.table("lineitem").withColumn("at_ts", F.col("l_shipdate").cast("timestamp"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        j = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("_one", F.lit(1))
        j = number_rows(j, ["_one"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                                      "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
                                      "l_tax"],
                        cut(li, F.unix_millis("at_ts")), "seq")
        return j.select(
            "seq", F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("code-"), F.col("l_partkey")).alias("typed_code"),
            F.col("o_orderpriority").alias("plan_id"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("original_kopecks"), "at_ts")

    # event streams -------------------------------------------------------------------
    def rejections(self) -> DataFrame:
        t, e = F.col("event_type"), F.col("event_id")
        return self.table("events").select("event_id", (
            F.when(t == "error", F.concat(F.lit("app_policy.quota.storage:current="), e,
                                          F.lit(",limit=5000")))
            .when(t == "click", "RpcException: UNAUTHENTICATED")
            .when(t == "view", "PAYMENT_REQUIRED for user")
            .when(t == "signup", "permission_denied: vault").otherwise("socket closed")
        ).alias("msg"))

    def file_events(self) -> DataFrame:
        return to_file_events(self.events())

    def blob_chunks(self) -> DataFrame:
        return to_blob_chunks(self.table("lineitem"))

    def biz(self) -> DataFrame:
        return to_biz(self.events())

    def paths(self) -> DataFrame:
        e = F.col("event_id")
        names = F.array(
            F.lit("app.json"), F.lit(".obsidian/appearance.json"), F.lit("workspace.json"),
            F.lit("community-plugins.json"),
            F.concat(F.lit("plugins/p"), e % 9, F.lit("/data.json")), F.lit("plugins/p1/main.js"),
            F.concat(F.lit("themes/t"), e % 4, F.lit("/theme.css")), F.lit("snippets/a.css"),
            F.lit("snippets/a.txt"), F.lit("daily-notes.json"), F.lit("../x.json"),
            F.lit("x.sqlite"))
        return self.table("events").select(
            "event_id", F.element_at(names, (e % 12 + 1).cast("int")).alias("path"))


# The plan catalogue of the test inputs.
PLANS = [
    ("1-URGENT", 49900, 365, True, False, 10, 104857600, 5368709120, "paid"),
    ("2-HIGH", 29900, 90, True, True, 5, 52428800, 1073741824, "paid"),
    ("3-MEDIUM", 9900, 30, True, False, 1, 10485760, 52428800, "paid"),
    ("4-NOT SPECIFIED", 0, 14, True, False, 1, 10485760, 52428800, "trial"),
    ("5-LOW", 0, 30, False, True, None, None, None, "promo"),
]


def with_state_columns(w: DataFrame) -> DataFrame:
    """Path and chunk list of each write, from its file and ``k``."""
    ext = F.when(F.substring("file_id", 2, 20).cast("long") % 2 == 0, ".md").otherwise(".png")
    chunks = F.when(~F.col("tombstone"), F.array(
        F.concat(F.lit("c"), F.col("k")), F.concat(F.lit("c"), (F.col("k") * 7) % 100))
    ).otherwise(F.array().cast("array<string>"))
    return (w.withColumn("path", F.concat(F.lit("notes/"), F.col("file_id"), ext))
            .withColumn("chunks", chunks))


def to_file_events(events: DataFrame) -> DataFrame:
    """Editor events of the raw event table; works on a stream as well."""
    t, e, u = F.col("event_type"), F.col("event_id"), F.col("user_id") % 40
    kind = (F.when(t == "view", "typing").when(t == "click", "modified")
            .when(t == "signup", "created").when(t == "purchase", "moved").otherwise("deleted"))
    return events.select(
        "event_id", "ts", F.concat(F.lit("d"), F.col("user_id") % 3).alias("device"),
        F.concat(F.lit("n"), u, F.lit(".md")).alias("path"), kind.alias("kind"),
        F.when((t == "purchase") & (e % 4 != 0), F.concat(F.lit("old"), u, F.lit(".md"))
               ).alias("old_path"))


def to_blob_chunks(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("blob_id"), F.col("l_linenumber").alias("off"),
        F.round("l_quantity").cast("long").alias("len"),
        F.col("l_shipdate").cast("timestamp").alias("ts"))


def to_biz(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    name = (F.when(t == "signup", "user.registered").when(t == "click", "user.signed_in")
            .when(t == "view", "sync.session_started").when(t == "purchase", "payment.completed")
            .otherwise("vault.created"))
    return events.select("ts", "user_id", name.alias("name"), F.when(
        t == "purchase", F.round(F.col("value") * 100).cast("long")).alias("amount_kopecks"))

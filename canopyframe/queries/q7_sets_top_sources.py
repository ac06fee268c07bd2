"""Top-k and sampling, set operations, sources and sinks, streaming, and the remaining analyses."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import labels as L
from canopyframe.operators import splits as S
from canopyframe.plans.ranking import global_row_number
from canopyframe.queries import split_sql as Q
from canopyframe.queries.base import query
from canopyframe.sources import files as IO
from canopyframe.streaming import labels as ST


def chips(t):
    return K.with_identity(L.latest(t.label_events()))


def curated(t):
    return K.with_identity(L.curate(t.label_events()))


def rank_by(df, by, *order):
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


KEYS = "raster, row_off, col_off"
AL = "a AS (SELECT * FROM scores WHERE model = 'alpha')"


def alpha(t):
    return t.scores().filter("model = 'alpha'")


@query("top01_labeling_queue", f"SELECT {KEYS}, model_prob FROM latest WHERE model_prob >= 0.3 ORDER BY model_prob DESC, {KEYS} LIMIT 300")
def _(t):
    return chips(t).filter("model_prob >= 0.3").orderBy(F.desc("model_prob"), *L.KEY).limit(300).select(*L.KEY, "model_prob")


@query("top02_queue_page", f"SELECT {KEYS}, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY model_prob DESC NULLS LAST, {KEYS}) AS rn FROM latest) ORDER BY rn LIMIT 50 OFFSET 100")
def _(t):
    rows = global_row_number(chips(t).select(*L.KEY, "model_prob"), [F.desc_nulls_last("model_prob"), *[F.asc(k) for k in L.KEY]], name="rank")
    return rows.orderBy("rank").offset(100).limit(50).select(*L.KEY, "rank")


@query("top03_top_mismatches", f"WITH {AL}, m AS (SELECT key, abs(prob - y) AS gap, row_number() OVER (ORDER BY abs(prob - y) DESC, key) AS rn, count(*) OVER () AS n FROM a WHERE (prob >= 0.5) <> (y = 1)) SELECT key, round(gap, 6) AS gap FROM m WHERE rn <= greatest(1, CAST(floor(n * 0.1) AS INTEGER))")
def _(t):
    wrong = alpha(t).filter((F.col("prob") >= 0.5) != (F.col("y") == 1)).select("key", F.abs(F.col("prob") - F.col("y")).alias("gap"))
    rows = global_row_number(wrong, [F.desc("gap"), F.asc("key")])
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.1)).alias("n")).scalar()
    return rows.filter(F.col("rn") <= n).select("key", F.round("gap", 6).alias("gap"))


@query("top04_extremes_with_ties", f"WITH {AL} SELECT 'fp' AS kind, key, prob FROM a WHERE source = 'manual' AND y = 0 AND prob = (SELECT max(prob) FROM a WHERE source = 'manual' AND y = 0) UNION ALL SELECT 'tn', key, prob FROM a WHERE y = 0 AND prob = (SELECT min(prob) FROM a WHERE y = 0)")
def _(t):
    a = alpha(t).filter("y = 0")
    m = a.filter("source = 'manual'")
    top = m.filter(F.col("prob") == m.agg(F.max("prob")).scalar()).select(F.lit("fp").alias("kind"), "key", "prob")
    return top.union(a.filter(F.col("prob") == a.agg(F.min("prob")).scalar()).select(F.lit("tn"), "key", "prob"))


@query(
    "top06_manual_review_queue",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY md5('q|' || arrival), arrival) AS rn, count(*) OVER (PARTITION BY place_key) AS n FROM latest WHERE source LIKE 'auto%' AND NOT coalesce(model_prob BETWEEN 0.4 AND 0.6, false)) SELECT arrival, 'spot' AS why FROM r WHERE rn <= greatest(1, round_even(n * 0.05, 0)) UNION ALL SELECT arrival, 'low' FROM latest WHERE source LIKE 'auto%' AND model_prob BETWEEN 0.4 AND 0.6",
)
def _(t):
    auto = chips(t).filter("source LIKE 'auto%'")
    low = F.coalesce(F.col("model_prob").between(0.4, 0.6), F.lit(False))
    spot = L.stratified_sample(auto.filter(~low), ["place_key"], 0.05, ["arrival"], "q")
    return spot.select("arrival", F.lit("spot").alias("why")).union(auto.filter(low).select("arrival", F.lit("low")))


CF = "CASE WHEN prob >= 0.5 AND y = 1 THEN 'tp' WHEN prob >= 0.5 THEN 'fp' WHEN y = 1 THEN 'fn' ELSE 'tn' END"


@query("top07_per_confusion_class", f"WITH {AL}, c AS (SELECT key, {CF} AS kind, row_number() OVER (PARTITION BY {CF} ORDER BY prob DESC, key) AS rn FROM a) SELECT key, kind FROM c WHERE rn <= 5")
def _(t):
    hit, pos = F.col("prob") >= 0.5, F.col("y") == 1
    kind = F.when(hit & pos, "tp").when(hit, "fp").when(pos, "fn").otherwise("tn")
    return rank_by(alpha(t).withColumn("kind", kind), ["kind"], F.desc("prob"), "key").filter("rn <= 5").select("key", "kind")


@query("top08_class_balanced", f"SELECT {KEYS}, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('b|' || arrival), arrival) AS rn FROM curated) WHERE rn <= 100")
def _(t):
    return rank_by(curated(t), ["label"], F.md5(F.concat_ws("|", F.lit("b"), F.col("arrival").cast("string"))), "arrival").filter("rn <= 100").select(*L.KEY, "label")


@query(
    "top09_augmented_test_split",
    f"WITH base AS (SELECT * FROM curated WHERE arrival % 10 = 0), rest AS (SELECT *, row_number() OVER (PARTITION BY label, raster ORDER BY md5('t|' || arrival), arrival) AS rn, count(*) OVER (PARTITION BY label, raster) AS n FROM curated WHERE arrival % 10 <> 0), q AS (SELECT * FROM rest WHERE n >= 3 AND rn <= greatest(1, round_even(n * 0.1, 0)) ORDER BY md5('t|' || arrival), arrival LIMIT 200) SELECT {KEYS} FROM base UNION ALL SELECT {KEYS} FROM q",
)
def _(t):
    c = curated(t)
    base = c.filter("arrival % 10 = 0").select(*L.KEY)
    rest = c.join(base, L.KEY, "left_anti")
    n = rest.groupBy("label", "raster").agg(F.count("*").alias("n")).filter("n >= 3")
    more = L.stratified_sample(rest.join(n, ["label", "raster"], "left_semi"), ["label", "raster"], 0.1, ["arrival"], "t")
    more = more.orderBy(F.md5(F.concat_ws("|", F.lit("t"), F.col("arrival").cast("string"))), "arrival").limit(200)
    return base.union(more.select(*L.KEY))


@query("top10_ratio_split", "SELECT arrival, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (SELECT arrival, row_number() OVER (PARTITION BY label ORDER BY md5('r|' || arrival), arrival) AS rn, count(*) OVER (PARTITION BY label) AS n FROM curated)")
def _(t):
    c = curated(t).select("arrival", "label", S.hashed("r", "arrival").alias("h"))
    rows = global_row_number(c, [F.asc("h"), F.asc("arrival")], ["label"])
    rows = rows.join(F.broadcast(rows.groupBy("label").agg(F.count("*").alias("n"))), "label")
    split = F.when(F.col("rn") <= F.floor(F.col("n") * 0.7), "train").when(F.col("rn") <= F.floor(F.col("n") * 0.85), "val").otherwise("test")
    return rows.select("arrival", split.alias("split"))


@query("top11_negative_top_up", "SELECT arrival FROM curated WHERE label = 'cdw' UNION ALL SELECT arrival FROM (SELECT arrival, row_number() OVER (ORDER BY md5('n|' || arrival), arrival) AS rn FROM curated WHERE label = 'no_cdw') WHERE rn <= (SELECT CAST(floor(count(*) * 1.5) AS BIGINT) FROM curated WHERE label = 'cdw')")
def _(t):
    c = curated(t)
    pos = c.filter("label = 'cdw'").select("arrival")
    most = int(pos.count() * 1.5)
    neg = c.filter("label = 'no_cdw'").orderBy(S.hashed("n", "arrival"), "arrival").limit(most)
    return pos.union(neg.select("arrival"))


@query("top12_raster_cap", "SELECT arrival FROM (SELECT arrival, row_number() OVER (PARTITION BY raster ORDER BY row_off, col_off) AS rn FROM latest) WHERE rn <= 20")
def _(t):
    return rank_by(chips(t), ["raster"], "row_off", "col_off").filter("rn <= 20").select("arrival")


@query("win10_ranked_list_dedup", f"SELECT {KEYS}, p FROM (SELECT {KEYS}, max(model_prob) AS p FROM label_events WHERE model_prob IS NOT NULL GROUP BY ALL) ORDER BY p DESC, {KEYS} LIMIT 500")
def _(t):
    best = t.label_events().filter("model_prob IS NOT NULL").groupBy(*L.KEY).agg(F.max("model_prob").alias("p"))
    return best.orderBy(F.desc("p"), *L.KEY).limit(500)


@query("x18_per_split_sample", f"WITH {AL} SELECT key, split FROM (SELECT key, split, row_number() OVER (PARTITION BY split ORDER BY md5('m|' || key), key) AS rn FROM a) WHERE rn <= 25")
def _(t):
    return rank_by(alpha(t), ["split"], S.hashed("m", "key"), "key").filter("rn <= 25").select("key", "split")


@query("x17_examples_per_state", "SELECT state, arrival FROM (SELECT l.arrival, coalesce(c.label, 'unlabeled') AS state, row_number() OVER (PARTITION BY coalesce(c.label, 'unlabeled') ORDER BY md5('e|' || l.arrival), l.arrival) AS rn FROM latest l LEFT JOIN curated c ON l.raster = c.raster AND l.row_off = c.row_off AND l.col_off = c.col_off) WHERE rn <= 6")
def _(t):
    c = curated(t).select(*L.KEY, F.col("label").alias("c"))
    rows = chips(t).join(c, L.KEY, "left").withColumn("state", F.coalesce("c", F.lit("unlabeled")))
    return rank_by(rows, ["state"], S.hashed("e", "arrival"), "arrival").filter("rn <= 6").select("state", "arrival")


# sets


@query("set01_split_overlaps", f"WITH {AL}, s AS (SELECT DISTINCT split, lang FROM a) SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y ON x.lang = y.lang AND x.split < y.split GROUP BY ALL")
def _(t):
    s = {n: alpha(t).filter(F.col("split") == n).select("lang") for n in ("test", "train", "val")}
    parts = [s[a].intersect(s[b]).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("shared")) for a, b in (("test", "train"), ("test", "val"), ("train", "val"))]
    return parts[0].union(parts[1]).union(parts[2]).filter("shared > 0")


@query("set02_pool_validation", "SELECT arrival, CASE WHEN model_prob IS NULL THEN 'no_prob' ELSE 'inside_band' END AS reason FROM curated WHERE source = 'auto_threshold_gate_v4' AND arrival % 2 = 0 AND (model_prob IS NULL OR model_prob BETWEEN 0.02 AND 0.98)")
def _(t):
    pool = curated(t).filter("source = 'auto_threshold_gate_v4' AND arrival % 2 = 0")
    p = F.col("model_prob")
    reason = F.when(p.isNull(), "no_prob").when(p.between(0.02, 0.98), "inside_band")
    return pool.select("arrival", reason.alias("reason")).filter("reason IS NOT NULL")


@query("set03_split_coverage", f"WITH {AL} SELECT (SELECT count(*) FROM (SELECT key FROM a EXCEPT SELECT key FROM a WHERE split IN ('train', 'val'))) AS uncovered, (SELECT count(*) FROM (SELECT key FROM a WHERE split = 'train' INTERSECT SELECT key FROM a WHERE split = 'test')) AS twice")
def _(t):
    a = alpha(t).select("key", "split")
    missing = a.select("key").subtract(a.filter("split IN ('train', 'val')").select("key")).select(F.lit(1).alias("u"), F.lit(0).alias("w"))
    twice = a.filter("split = 'train'").select("key").intersect(a.filter("split = 'test'").select("key")).select(F.lit(0).alias("u"), F.lit(1).alias("w"))
    return missing.union(twice).agg(F.coalesce(F.sum("u"), F.lit(0)).alias("uncovered"), F.coalesce(F.sum("w"), F.lit(0)).alias("twice"))


@query("set04_key_intersection", "SELECT sample_id FROM samples WHERE has_raw INTERSECT SELECT sample_id FROM samples WHERE has_gauss INTERSECT SELECT sample_id FROM samples WHERE has_baseline")
def _(t):
    s = t.samples()
    pick = lambda n: s.filter(f"has_{n}").select("sample_id")
    return pick("raw").intersect(pick("gauss")).intersect(pick("baseline"))


@query("set05_label_union", f"SELECT DISTINCT {KEYS} FROM label_events WHERE source = 'manual' OR label = 'cdw'")
def _(t):
    e = t.label_events()
    return e.filter("source = 'manual'").select(*L.KEY).unionByName(e.filter("label = 'cdw'").select(*L.KEY)).distinct()


@query("set06_column_union", "SELECT arrival, raster, CASE WHEN arrival % 2 = 0 THEN label END AS label, CASE WHEN arrival % 2 = 1 THEN model_prob END AS model_prob FROM label_events")
def _(t):
    e = t.label_events()
    return IO.union_by_name([e.filter("arrival % 2 = 0").select("arrival", "raster", "label"), e.filter("arrival % 2 = 1").select("model_prob", "arrival", "raster")])


# sources and sinks


def written_labels(t):
    e = t.label_events()
    return IO.read_labels(t.spark, IO.write_labels(e, IO.scratch(t.spark, "labels")))


@query("src01_label_csv_scan", "SELECT raster, row_off, col_off, label, source, model_prob FROM label_events WHERE label IN ('cdw', 'no_cdw')")
def _(t):
    return written_labels(t).select(*L.KEY, "label", "source", "model_prob")


@query("src02_curated_loader", "SELECT raster, row_off, col_off, chunk_size, label, model_prob, timestamp FROM curated")
def _(t):
    c = L.curate(t.label_events())
    return IO.read_labels(t.spark, IO.write_labels(c, IO.scratch(t.spark, "curated"))).select(*L.KEY, "chunk_size", "label", "model_prob", "timestamp")


@query("src03_file_tags", "SELECT raster AS file, count(*) AS n FROM label_events WHERE label IN ('cdw', 'no_cdw') GROUP BY raster")
def _(t):
    return written_labels(t).groupBy("file").agg(F.count("*").alias("n"))


@query("src04_event_table", "SELECT raster, arrival, row_number() OVER (PARTITION BY raster ORDER BY arrival) AS line, row_number() OVER (ORDER BY raster, arrival) AS event_index, true AS addressable, '{\"arrival\":' || arrival || ',\"col_off\":' || col_off || ',\"label\":\"' || label || '\",\"row_off\":' || row_off || '}' AS raw FROM label_events")
def _(t):
    e = t.label_events().select(F.col("raster").alias("file"), "arrival", "row_off", "col_off", "label")
    return IO.event_table(e, ["arrival"]).select(F.col("file").alias("raster"), "arrival", "line", "event_index", "addressable", "raw")


@query("src09_external_scores", "SELECT key, model, prob FROM scores")
def _(t):
    folder = IO.scratch(t.spark, "scores")
    t.scores().select("key", "model", "prob").write.option("header", True).csv(folder)
    return t.spark.read.option("header", True).schema("key bigint, model string, prob double").csv(folder)


@query("src10_session_scan", "SELECT 's' || (o_custkey % 50) AS session, CASE o_orderstatus WHEN 'P' THEN 'tp' WHEN 'F' THEN 'fp' ELSE 'fn' END AS section, 'r' || (o_custkey % 7) AS raster, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    o = t.raw("orders")
    section = F.when(F.col("o_orderstatus") == "P", "tp").when(F.col("o_orderstatus") == "F", "fp").otherwise("fn")
    counted = o.groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("session"), section.alias("section"), F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("raster")).agg(F.count("*").alias("n"))
    nested = counted.groupBy("session").agg(*[F.collect_list(F.when(F.col("section") == s, F.struct("raster", "n"))).alias(s) for s in ("tp", "fp", "fn")])
    return IO.read_sessions(t.spark, IO.write_json(nested, IO.scratch(t.spark, "sessions")))


@query("src11_annotation_export", "SELECT conv_id AS id, md5(text) AS text FROM conversations c WHERE role = 'assistant' AND turn // 2 = (SELECT max(turn // 2) FROM conversations d WHERE d.conv_id = c.conv_id)")
def _(t):
    c = t.raw("conversations")
    result = F.struct(F.col("role").alias("label"), F.md5("text").alias("text"))
    notes = c.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("created")).agg(F.collect_list(result).alias("result"))
    tasks = notes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("created", "result"))).alias("annotations"))
    return IO.latest_annotations(tasks.select(F.to_json(F.struct(F.col("conv_id").alias("id"), "annotations")).alias("task")), "task", "assistant")


@query("src12_manifest_reader", f"SELECT {KEYS} FROM curated WHERE arrival % 5 < 2")
def _(t):
    c = curated(t).withColumn("role", F.when(F.col("arrival") % 5 < 2, "test").otherwise("train"))
    # half of the rows in each of the two shapes of manifests
    a = IO.split_manifest(c.filter("arrival % 2 = 0"))
    b = c.filter("arrival % 2 = 1").groupBy("place_key", "role").agg(F.collect_list(F.struct(*L.KEY)).alias("keys"))
    b = b.select(F.create_map("role", "keys").alias("splits"))
    folder = IO.scratch(t.spark, "manifests")
    IO.write_json(a, f"{folder}/a")
    IO.write_json(b, f"{folder}/b")
    return IO.read_manifests(t.spark, f"{folder}/*")


@query("src13_page_links", "SELECT DISTINCT page_id, href, regexp_extract(href, '([^/]*)$', 1) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def _(t):
    return IO.page_links(t.raw("pages"))


@query("snk01_curated_labels", "SELECT raster, count(*) AS n, min(row_off * 1000 + col_off) AS first_chip FROM curated GROUP BY raster")
def _(t):
    back = IO.read_labels(t.spark, IO.write_labels(L.curate(t.label_events()), IO.scratch(t.spark, "snk")))
    return back.groupBy("raster").agg(F.count("*").alias("n"), F.min(F.col("row_off") * 1000 + F.col("col_off")).alias("first_chip"))


@query("snk02_labels_per_variant", "SELECT v || '_' || raster AS raster, v AS variant, count(*) AS n FROM curated, (SELECT unnest(['raw', 'gauss']) AS v) GROUP BY ALL")
def _(t):
    rows = L.curate(t.label_events()).withColumn("variant", F.explode(F.lit(["raw", "gauss"]))).withColumn("raster", F.concat_ws("_", "variant", "raster"))
    folder = IO.scratch(t.spark, "variants")
    rows.repartition("variant", "raster").write.partitionBy("variant").parquet(folder)
    return t.spark.read.parquet(folder).groupBy("raster", "variant").agg(F.count("*").alias("n"))


@query("snk03_split_manifest", f"WITH RECURSIVE {Q.chip_roles('place_key')} SELECT raster, row_off, col_off FROM ro WHERE role = 'test'")
def _(t):
    return IO.read_manifests(t.spark, IO.write_json(IO.split_manifest(S.chip_split(curated(t))), IO.scratch(t.spark, "split")))


@query("snk03_manifest_meta", "SELECT count(*) AS total_rows, CAST(count(*) FILTER (arrival % 5 = 0) AS BIGINT) AS test_rows, CAST(count(*) FILTER (arrival % 5 = 1) AS BIGINT) AS buffer_rows, CAST(count(*) FILTER (arrival % 5 > 1) AS BIGINT) AS train_rows, count(DISTINCT place_key) AS places FROM curated")
def _(t):
    a = F.col("arrival") % 5
    return IO.manifest_meta(curated(t).withColumn("role", F.when(a == 0, "test").when(a == 1, "buffer").otherwise("train")))


def geo(minx, miny, maxx, maxy):
    at = lambda x, y: f"'[' || CAST(({x})::DOUBLE AS VARCHAR) || ',' || CAST(({y})::DOUBLE AS VARCHAR) || ']'"
    return "'{\"type\":\"Polygon\",\"coordinates\":[[' || " + " || ',' || ".join(at(x, y) for x, y in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))) + " || ']]}'"


@query("snk04_place_geojson", f"WITH p AS (SELECT place_key, grid_x, grid_y, count(*) AS n FROM curated GROUP BY ALL) SELECT place_key, '{{\"type\":\"Feature\",\"geometry\":' || {geo('grid_y * 1000', 'grid_x * 1000', 'grid_y * 1000 + 1000', 'grid_x * 1000 + 1000')} || ',\"properties\":{{\"place\":\"' || place_key || '\",\"rows\":' || n || ',\"colour\":\"#2ca02c\"}}}}' AS feature FROM p")
def _(t):
    p = S.place_registry(curated(t)).select("place_key", "rows", K.tile_bounds(F.col("grid_x"), F.col("grid_y"), north=0).alias("b"))
    shape = IO.polygon(F.col("b.minx"), F.col("b.miny"), F.col("b.maxx"), F.col("b.maxy"))
    return p.select("place_key", IO.feature(shape, place=F.col("place_key"), rows=F.col("rows"), colour=F.lit(IO.COLOURS["train"])).alias("feature"))


@query("snk05_block_geojson", f"WITH b AS (SELECT raster, row_off // 256 AS br, col_off // 256 AS bc, count(*) AS n FROM curated GROUP BY ALL) SELECT raster, br, bc, '{{\"type\":\"Feature\",\"geometry\":' || {geo('bc * 64', 'br * 64', 'bc * 64 + 64', 'br * 64 + 64')} || ',\"properties\":{{\"chips\":' || n || '}}}}' AS feature FROM b")
def _(t):
    b = curated(t).groupBy("raster", F.floor(F.col("row_off") / 256).cast("int").alias("br"), F.floor(F.col("col_off") / 256).cast("int").alias("bc")).agg(F.count("*").alias("n"))
    shape = IO.polygon(F.col("bc") * 64, F.col("br") * 64, F.col("bc") * 64 + 64, F.col("br") * 64 + 64)
    return b.select("raster", "br", "bc", IO.feature(shape, chips=F.col("n")).alias("feature"))


@query("snk07_metric_report", "SELECT tile_id, unnest(['points', 'ground', 'max_intensity']) AS metric, unnest([count(*)::DOUBLE, (count(*) FILTER (classification = 2))::DOUBLE, max(intensity)]) AS value FROM points GROUP BY tile_id")
def _(t):
    g = t.points().groupBy("tile_id").agg(F.count("*").cast("double").alias("points"), F.count_if(F.col("classification") == 2).cast("double").alias("ground"), F.max("intensity").alias("max_intensity"))
    folder = IO.scratch(t.spark, "report")
    g.unpivot("tile_id", ["points", "ground", "max_intensity"], "metric", "value").write.option("header", True).csv(folder)
    return t.spark.read.option("header", True).schema("tile_id string, metric string, value double").csv(folder)


# streaming


def stream(t):
    folder = IO.scratch(t.spark, "events")
    e = t.raw("events").select(F.col("event_id").alias("arrival"), "ts")
    t.label_events().join(e, "arrival").select("arrival", "ts", *L.KEY, "label", "source", "annotator", "model_prob").repartition(4).write.parquet(folder)
    return ST.ingest(t.spark, folder), IO.scratch(t.spark, "stream")


@query("str01_stream_ingest", "SELECT arrival, raster, label FROM label_events")
def _(t):
    s, folder = stream(t)
    return ST.drain(s.select("arrival", "raster", "label"), folder)


@query("str02_latest_state", f"SELECT {KEYS}, arrival, label, source FROM latest")
def _(t):
    s, folder = stream(t)
    return ST.drain(ST.latest_state(s), folder, "update", L.KEY)


@query("str02_keyed_state", f"SELECT {KEYS}, arrival, label, source FROM latest")
def _(t):
    s, folder = stream(t)
    return ST.drain(ST.keyed_latest_state(s), folder, "update", L.KEY, "arrival")


TPUT = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", source, count(*) AS n FROM label_events JOIN events ON arrival = event_id GROUP BY ALL"


@query("str03_throughput", TPUT)
def _(t):
    s, folder = stream(t)
    return ST.drain(ST.throughput(s), folder, "complete")


@query(
    "str04_annotator_sessions",
    "WITH e AS (SELECT annotator, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY annotator ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM label_events JOIN events ON arrival = event_id), s AS (SELECT *, sum(new) OVER (PARTITION BY annotator ORDER BY ts) AS sid FROM e) SELECT annotator, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY annotator, sid",
)
def _(t):
    s, folder = stream(t)
    return ST.drain(ST.sessions(s), folder, "complete")


@query("str05_review_queue", "SELECT arrival FROM label_events WHERE model_prob BETWEEN 0.4 AND 0.6 AND source NOT IN ('manual', 'auto_reviewed')")
def _(t):
    s, folder = stream(t)
    q = s.writeStream.foreachBatch(ST.review_sink(f"{folder}/review")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/review").select("arrival")


# further analyses


@query("x09_flatten_reports", "SELECT run, variant, count(*) AS n, max(f1) AS best FROM runs GROUP BY run, variant")
def _(t):
    nested = t.runs().groupBy("run", "variant").agg(F.struct(F.count("*").alias("n"), F.struct(F.max("f1").alias("best")).alias("metrics")).alias("report"))
    folder = IO.write_json(nested, IO.scratch(t.spark, "reports"))
    raw = t.spark.read.schema("run int, variant string, report struct<n:bigint,metrics:struct<best:double>>").json(folder)
    return raw.select("run", "variant", "report.n", "report.metrics.best")


@query("x10_newest_manual_in_queue", "SELECT raster, max(arrival) AS arrival FROM label_events e WHERE source = 'manual' AND EXISTS (SELECT 1 FROM latest l WHERE l.raster = e.raster AND l.row_off = e.row_off AND l.col_off = e.col_off AND l.model_prob >= 0.3) GROUP BY raster")
def _(t):
    e = t.label_events()
    queue = L.latest(e).filter("model_prob >= 0.3").select(*L.KEY)
    return e.filter("source = 'manual'").join(queue, L.KEY, "left_semi").groupBy("raster").agg(F.max("arrival").alias("arrival"))


QD = "q AS (SELECT raster, row_off, col_off, source IN ('manual', 'auto_reviewed') AS done, row_number() OVER (PARTITION BY raster ORDER BY row_off, col_off) AS rn FROM latest), p AS (SELECT raster, max(rn) AS pointer FROM q WHERE done AND rn <= 3 GROUP BY raster), ok AS (SELECT p.raster, pointer, bool_and(done) AS trim FROM p JOIN q ON p.raster = q.raster AND q.rn <= p.pointer GROUP BY ALL)"


@query("x11_queue_resume", f"WITH {QD} SELECT q.raster, q.row_off, q.col_off FROM q LEFT JOIN ok USING (raster) WHERE NOT coalesce(trim, false) OR rn > pointer")
def _(t):
    q = rank_by(chips(t).select(*L.KEY, K.is_manual().alias("done")), ["raster"], "row_off", "col_off")
    p = q.filter("done AND rn <= 3").groupBy("raster").agg(F.max("rn").alias("pointer"))
    ok = q.join(p, "raster").filter("rn <= pointer").groupBy("raster", "pointer").agg(F.bool_and("done").alias("trim"))
    return q.join(ok, "raster", "left").filter("NOT coalesce(trim, false) OR rn > pointer").select(*L.KEY)


@query("x12_pending_counts", "SELECT raster, count(*) AS total, CAST(count(*) FILTER (source NOT IN ('manual', 'auto_reviewed')) AS BIGINT) AS pending FROM latest GROUP BY raster")
def _(t):
    return chips(t).groupBy("raster").agg(F.count("*").alias("total"), F.count_if(~K.is_manual()).alias("pending"))


@query("x15_backfill", "SELECT l.arrival, coalesce(s.p, 0.0::DOUBLE) AS model_prob FROM latest l LEFT JOIN (SELECT raster, row_off, col_off, max(model_prob) AS p FROM label_events GROUP BY ALL) s ON l.raster = s.raster AND l.row_off = s.row_off AND l.col_off = s.col_off")
def _(t):
    e = t.label_events()
    best = e.groupBy(*L.KEY).agg(F.max("model_prob").alias("model_prob"))
    return IO.backfill(L.latest(e).drop("model_prob"), best, L.KEY).select("arrival", "model_prob")


@query("x19_image_names", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'img' || page_id || '.png' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) END AS name FROM pages")
def _(t):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://host.example/data/?d=a/b/img"), F.col("page_id").cast("string"), F.lit(".png"))).otherwise(F.col("url"))
    return t.raw("pages").select("page_id", IO.image_name(url).alias("name"))


SIZE = "(60 + (p_partkey * 53) % 1100)"


@query("udtf01_chip_offsets", f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(unnest(CASE WHEN {SIZE} <= 128 THEN [0] WHEN ({SIZE} - 128) % 64 > 32 THEN list_append(range(0, {SIZE} - 127, 64), {SIZE} - 128) ELSE range(0, {SIZE} - 127, 64) END) AS INTEGER) AS row_off FROM samples")
def _(t):
    from canopyframe.functions import udtf

    udtf.register(t.spark)
    t.samples().createOrReplaceTempView("canopyframe_samples")
    return t.spark.sql(f"SELECT p_partkey, o.row_off FROM canopyframe_samples s, LATERAL chip_offsets(cast({SIZE} as int), 128, 64) o")

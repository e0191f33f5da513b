"""The registered queries of the library over the benchmark tables, each with SQL for DuckDB where it has a form."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, phones, tags, texts
from ..ml import labels, model
from ..operators import dedup, filters, geo, history, market, snapshot, stats
from ..operators.skew import fresh_path
from ..sources import files, pages, sites
from ..streaming import listings as streams
from .listings import DISTRICTS, HISTORY, LISTINGS, RATES, STATIONS, duck
from .listings import history as price_log
from .listings import listings as all_listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
L = f"WITH listings AS ({duck(LISTINGS)})"
H = f"WITH history AS ({duck(HISTORY)})"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_listings(spark, sf_dir).withColumn("district_name", geo.district_of(F.col("lat"), F.col("lon"), DISTRICTS))


def _pip_sql() -> str:
    """District of each listing by crossings of an inline edge table."""
    edges = [f"({k}, '{name}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (name, p) in enumerate(DISTRICTS) if len(p) > 2 for a, b in zip(p, p[1:] + p[:1], strict=True)]
    return f"""edges(ord, name, y1, x1, y2, x2) AS (VALUES {", ".join(edges)}), hits AS (
      SELECT id, ord, name FROM listings, edges WHERE (y1 > lat) <> (y2 > lat) AND lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1 GROUP BY id, ord, name HAVING count(*) % 2 = 1
    ), placed AS (SELECT l.*, (SELECT arg_min(name, ord) FROM hits h WHERE h.id = l.id) AS district_name FROM listings l)"""


PIP = f"{L}, {_pip_sql()}"


# Searches


@query(f"{PIP} SELECT district_name, CAST(rooms AS INT) AS rooms, median(price) AS median_price, count(price) AS n FROM placed WHERE price >= 50000 AND area >= 30 GROUP BY ALL HAVING count(price) >= 3")
def median_per_district(spark, sf_dir):
    own = filters.search(located(spark, sf_dir), filters.Search(price=(50_000, None), area=(30, None)), nulls="drop")
    return market.median_by(own, ["district_name", "rooms"], least=3)


@query(f"""{L} SELECT id, price FROM listings WHERE price BETWEEN 50000 AND 250000 AND (area IS NULL OR area BETWEEN 30 AND 80) AND (floor IS NULL OR floor >= 2)
  AND (rooms IS NULL OR rooms IN (1, 2, 4) OR rooms >= 4) AND contains(lower(address), 'nation_1') AND contains(lower(concat_ws(' ', title, address)), 'customer')""")
def search_keep_nulls(spark, sf_dir):
    s = filters.Search(rooms=(1, 2, 4), price=(50_000, 250_000), area=(30, 80), floor=(2, None), district="NATION_1", query="customer", query_fields=("title", "address"))
    return filters.search(all_listings(spark, sf_dir), s, nulls="keep").select("id", "price")


@query(f"""{L} SELECT id, price FROM listings WHERE price BETWEEN 50000 AND 250000 AND area BETWEEN 30 AND 80 AND floor >= 2 AND (rooms IN (1, 2, 4) OR rooms >= 4)
  AND CASE WHEN district IS NOT NULL THEN lower(district) = 'nation_1' ELSE regexp_matches(lower(concat_ws(' ', address, title)), '\\bnation_1\\b') END AND contains(lower(concat_ws(' ', title, address)), 'customer')""")
def search_drop_nulls(spark, sf_dir):
    s = filters.Search(rooms=(1, 2, 4), price=(50_000, 250_000), area=(30, 80), floor=(2, None), district="NATION_1", query="customer", query_fields=("title",))
    return filters.search(all_listings(spark, sf_dir), s, nulls="drop").select("id", "price")


@query(f"{L} SELECT id, source FROM listings WHERE source IN ('1-URGENT', '2-HIGH') AND (rooms IS NOT NULL OR area IS NOT NULL OR price IS NOT NULL)")
def source_selection(spark, sf_dir):
    return filters.has_substance(filters.search(all_listings(spark, sf_dir), filters.Search(sources=("1-URGENT", "2-HIGH")))).select("id", "source")


@query(f"""{L} SELECT id, round_even(price / area, 1) AS price_per_m2, round_even(price / nullif(rooms, 0), 1) AS price_per_room, round_even(floor / total_floors, 2) AS floor_ratio,
  CAST(coalesce(floor = 1, false) AS INT) AS is_first_floor, CAST(coalesce(floor = total_floors, false) AS INT) AS is_last_floor FROM listings""")
def derived_ratios(spark, sf_dir):
    rows = all_listings(spark, sf_dir).withColumns({"description": F.lit(""), "photos": F.array().cast("array<string>")})
    return labels.ratios(rows).select("id", "price_per_m2", "price_per_room", "floor_ratio", "is_first_floor", "is_last_floor")


@query(f"{L} SELECT id, CASE WHEN lat BETWEEN 43.1 AND 43.4 AND lon BETWEEN 76.7 AND 77.0 THEN lat END AS lat, CASE WHEN lat BETWEEN 43.1 AND 43.4 AND lon BETWEEN 76.7 AND 77.0 THEN lon END AS lon FROM listings")
def coordinate_guard(spark, sf_dir):
    own = all_listings(spark, sf_dir)
    return own.withColumn("at", filters.in_city(F.col("lat"), F.col("lon"), (43.1, 43.4, 76.7, 77.0))).select("id", "at.lat", "at.lon")


@query(f"{L} SELECT id, price FROM listings ORDER BY price NULLS LAST, url LIMIT 100")
def cheapest_hundred(spark, sf_dir):
    return filters.by_price(all_listings(spark, sf_dir)).limit(100).select("id", "price")


@query(f"{L} SELECT id, coalesce(date_updated, date_published) AS shown FROM (SELECT *, CASE WHEN id % 3 = 0 THEN date_published + 40 END AS date_updated FROM listings) ORDER BY shown DESC NULLS LAST, url, id LIMIT 500")
def newest_listings(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("date_updated", F.when(F.col("id") % 3 == 0, F.date_add("date_published", 40))).withColumn("url", F.concat("url", F.format_string("/%020d", "id")))
    return filters.by_date(own).limit(500).select("id", F.coalesce("date_updated", "date_published").alias("shown"))


@query("SELECT doc_id, prob FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN (n_chars % 100) / 100.0e0 END AS prob FROM documents) ORDER BY coalesce(prob, -1) DESC, doc_id LIMIT 400")
def scored_order(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 100) / F.lit(100.0)).alias("prob"), F.format_string("%020d", "doc_id").alias("url"))
    return filters.by_score(own).limit(400).select("doc_id", "prob")


@query("SELECT s_suppkey FROM supplier ORDER BY CAST(floor(s_acctbal) AS BIGINT) % 50 DESC NULLS LAST, s_suppkey LIMIT 200")
def latest_buildings(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").withColumn("updated_at", F.floor("s_acctbal") % 50)
    return filters.by_update(own, "s_suppkey").limit(200).select("s_suppkey")


@query(f"""{L} SELECT id, source, turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality_score, 0) DESC, price NULLS LAST, url) AS turn FROM listings)
  ORDER BY turn, source LIMIT 40""")
def fair_mix(spark, sf_dir):
    return filters.fair_mix(all_listings(spark, sf_dir), 40).select("id", "source", F.col("turn").cast("bigint").alias("turn"))


@query(f"{L} SELECT id FROM (SELECT *, CASE WHEN id % 9 <> 0 THEN date_published END AS checked FROM listings) WHERE checked IS NULL OR checked <= DATE '1998-06-01' ORDER BY checked NULLS FIRST, source, url, id LIMIT 30")
def recheck_candidates(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("checked_at", F.when(F.col("id") % 9 != 0, F.col("date_published")).cast("timestamp")).withColumn("url", F.concat("url", F.format_string("/%020d", "id")))
    return filters.recheck_candidates(own, F.lit("1998-06-01 06:00:00").cast("timestamp")).select("id")


# Places


@query(f"{PIP} SELECT id, district_name FROM placed")
def district_of_point(spark, sf_dir):
    return located(spark, sf_dir).select("id", "district_name")


@query(f"{PIP} SELECT id, district_name FROM placed")
def district_by_grid(spark, sf_dir):
    rows = [(name, k, [{"lat": y, "lon": x} for y, x in p]) for k, (name, p) in enumerate(DISTRICTS)]
    polygons = spark.createDataFrame(rows, "name string, ord int, polygon array<struct<lat: double, lon: double>>")
    return geo.join_districts(all_listings(spark, sf_dir), polygons).select("id", "district_name")


@query(f"""{L}, stations(name, y, x) AS (VALUES {", ".join(f"('{n}', {y}::DOUBLE, {x}::DOUBLE)" for n, y, x in STATIONS)}), d AS (
  SELECT id, name, 12742000 * asin(sqrt(pow(sin((radians(y) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin((radians(x) - radians(lon)) / 2), 2))) AS m FROM listings, stations)
  SELECT id, arg_min(name, m) AS station, CAST(round(min(m) / 50) AS BIGINT) AS fifties FROM d GROUP BY id""")
def nearest_station(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("s", geo.nearest_station(F.col("lat"), F.col("lon"), STATIONS))
    return own.select("id", "s.station", F.round(F.col("s.dist") / 50).cast("bigint").alias("fifties"))


@query(f"{L} SELECT id, coalesce(l.district, p.p_type) AS district, coalesce(l.area, p.p_size) AS area FROM listings l LEFT JOIN part p ON l.id % 3000 = p.p_partkey")
def join_buildings(spark, sf_dir):
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("building_id"), F.col("p_type").alias("district"), F.col("p_size").cast("double").alias("area"))
    return geo.join_buildings(all_listings(spark, sf_dir).withColumn("building_id", F.col("id") % 3000), b, ["district", "area"]).select("id", "district", "area")


# Dedup and snapshots

OLD = f"SELECT DISTINCT ON (source, url) source, url, price, date_published AS first_seen FROM (SELECT * FROM listings WHERE date_published < DATE '1999-01-01') ORDER BY source, url, date_published, id"
NEW = f"SELECT DISTINCT ON (source, url) source, url, price FROM (SELECT * FROM listings WHERE date_published >= DATE '1998-01-01') ORDER BY source, url, date_published DESC, id DESC"


def _halves(spark, sf_dir):
    own = all_listings(spark, sf_dir)
    old = dedup.first_of(own.filter("date_published < DATE'1999-01-01'"), ["source", "url"], [F.col("date_published"), F.col("id")])
    new = dedup.first_of(own.filter("date_published >= DATE'1998-01-01'"), ["source", "url"], [F.desc("date_published"), F.desc("id")])
    return old.select("source", "url", "price", F.col("date_published").alias("first_seen")), new.select("source", "url", "price")


@query(f"""{L}, old AS ({OLD}), new AS ({NEW}) SELECT coalesce(n.source, o.source) AS source, coalesce(n.url, o.url) AS url, coalesce(n.price, o.price) AS price,
  coalesce(o.first_seen, DATE '2001-01-01') AS first_seen, CASE WHEN n.url IS NOT NULL THEN o.url IS NULL END AS is_new,
  CASE WHEN n.price <> o.price THEN true END AS price_changed, CASE WHEN n.price <> o.price THEN o.price END AS prev_price, n.url IS NOT NULL AS seen
  FROM old o FULL JOIN new n ON o.source = n.source AND o.url = n.url""")
def snapshot_merge(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return snapshot.merge(old, new, F.lit("2001-01-01").cast("date"))


@query(f"""{L}, old AS ({OLD}), new AS ({NEW}), rated AS (SELECT *, CASE WHEN price % 3 <> 0 THEN CAST(price % 6 AS INT) END AS rating FROM old) SELECT coalesce(n.source, o.source) AS source, coalesce(n.url, o.url) AS url,
  CASE WHEN n.url IS NULL THEN o.rating END AS rating, CASE WHEN n.url IS NOT NULL THEN nullif(o.rating, 0) END AS prev_rating FROM rated o FULL JOIN new n ON o.source = n.source AND o.url = n.url""")
def snapshot_ratings(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    rated = old.withColumn("rating", F.when(F.col("price") % 3 != 0, (F.col("price") % 6).cast("int")))
    return snapshot.merge(rated, new, F.lit("2001-01-01").cast("date")).select("source", "url", "rating", "prev_rating")


@query(f"{L}, old AS ({OLD}), new AS ({NEW}) SELECT o.source, o.url, o.price FROM old o ANTI JOIN new n ON o.source = n.source AND o.url = n.url")
def not_seen_again(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return snapshot.not_seen(old, new).select("source", "url", "price")


@query(f"{L} SELECT arg_min(id, (price, id)) AS id, url FROM listings GROUP BY url")
def first_per_url(spark, sf_dir):
    return dedup.first_of(all_listings(spark, sf_dir), ["url"], [F.col("price"), F.col("id")]).select("id", "url")


FP = """concat_ws('|', lower(address), coalesce(CAST(rooms AS VARCHAR), '_'), coalesce(CAST(CAST(floor(area) AS BIGINT) AS VARCHAR), '_'), coalesce(CAST(floor AS VARCHAR), '_'),
  coalesce(CAST(price // 20000 * 20000 AS VARCHAR), '_'))"""


def _grouped(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("url", F.concat("url", F.lit("/"), F.col("id").cast("string")))
    return own.withColumn("duplicate_group_id", dedup.fingerprint(F.col("address"), F.col("rooms"), F.col("area"), F.col("floor"), F.col("price")))


@query(f"""{L}, g AS (SELECT *, {FP} AS f FROM listings), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY date_published, quality_score DESC, concat(url, '/', id)) AS k, count(*) OVER (PARTITION BY f) AS n FROM g)
  SELECT id, f AS duplicate_group_id, CAST(n AS INT) AS sources_count, CASE WHEN n > 1 THEN least(100, quality_score + 5) ELSE quality_score END AS quality_score FROM r WHERE k = 1""")
def fingerprint_masters(spark, sf_dir):
    return dedup.collapse(_grouped(spark, sf_dir)).select("id", "duplicate_group_id", "sources_count", "quality_score")


@query(f"""{L}, r AS (SELECT *, row_number() OVER (PARTITION BY rooms, round_even(area, 0), district ORDER BY price, url, id) AS k, count(*) OVER (PARTITION BY rooms, round_even(area, 0), district) AS n,
  rooms IS NOT NULL AND area IS NOT NULL AND district IS NOT NULL AS whole FROM listings) SELECT id, CAST(CASE WHEN whole THEN n ELSE 1 END AS INT) AS sources_count FROM r WHERE k = 1 OR NOT whole""")
def cheapest_of_alike(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("url", F.concat("url", F.format_string("/%020d", "id")))
    return dedup.cheapest(own).select("id", "sources_count")


@query(f"""{L}, x AS (SELECT id, address AS location, rooms, area, price FROM listings WHERE area IS NOT NULL AND price > 0) SELECT least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi FROM x a JOIN x b
  ON a.location = b.location AND a.rooms IS NOT DISTINCT FROM b.rooms AND a.id < b.id AND abs(a.area - b.area) <= 2 AND abs(a.price - b.price) <= 0.05 * greatest(a.price, b.price)""")
def near_listings(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumns({"location": F.col("address"), "url": F.format_string("%020d", "id")})
    return dedup.near_listings(own).select(F.col("a").cast("bigint").alias("lo"), F.col("b").cast("bigint").alias("hi"))


@query(f"""WITH RECURSIVE listings AS ({duck(LISTINGS)}), e AS (SELECT DISTINCT title AS url, phone AS mark FROM listings WHERE phone <> '' UNION SELECT DISTINCT title, CAST(org AS VARCHAR) FROM listings WHERE org = 3),
  c AS (SELECT e.url, (SELECT min(f.url) FROM e f WHERE f.mark = e.mark) AS cluster FROM e),
  d AS (SELECT url, min(cluster) AS cluster FROM c GROUP BY url), m AS (SELECT e.mark, min(d.cluster) AS cluster FROM e JOIN d USING (url) GROUP BY e.mark),
  d2 AS (SELECT e.url, min(m.cluster) AS cluster FROM e JOIN m USING (mark) GROUP BY e.url), m2 AS (SELECT e.mark, min(d2.cluster) AS cluster FROM e JOIN d2 USING (url) GROUP BY e.mark),
  d3 AS (SELECT e.url, min(m2.cluster) AS cluster FROM e JOIN m2 USING (mark) GROUP BY e.url)
  SELECT DISTINCT l.title AS url, coalesce(d3.cluster, l.title) AS cluster FROM listings l LEFT JOIN d3 ON l.title = d3.url""")
def contact_clusters(spark, sf_dir):
    own = all_listings(spark, sf_dir).select(F.col("title").alias("url"), "phone", F.when(F.col("org") == 3, F.col("org").cast("string")).alias("duplicate_group_id"))
    return dedup.contact_clusters(own)


@query("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 10 = 0""")
def upsert_organizations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.lit(1).alias("updated_at"))
    changed = s.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    new = s.filter("s_suppkey % 10 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return snapshot.upsert(s, changed.unionByName(new), "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query(f"""{H}, last AS (SELECT listing_key, arg_max(price, (checked_at, seq)) AS last FROM history GROUP BY listing_key), now AS (SELECT p_partkey AS listing_key, CASE WHEN p_partkey % 2 = 0 THEN last ELSE 5 END AS price, last FROM part LEFT JOIN last ON p_partkey = listing_key)
  SELECT listing_key, price FROM now WHERE price IS NOT NULL AND (last IS NULL OR price <> last)""")
def price_appends(spark, sf_dir):
    log = price_log(spark, sf_dir).withColumn("checked_at", F.struct("checked_at", "seq"))
    last = log.groupBy("listing_key").agg(F.max_by("price", "checked_at").alias("last"))
    now = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing_key")).join(last, "listing_key", "left").select("listing_key", F.when(F.col("listing_key") % 2 == 0, F.col("last")).otherwise(5).alias("price"), F.lit("KZT").alias("currency"))
    return snapshot.price_appends(log, now, F.current_timestamp()).select("listing_key", "price")


@query(f"{H} SELECT listing_key, count(*) AS n FROM history WHERE listing_key % 4 <> 0 GROUP BY listing_key")
def delete_with_history(spark, sf_dir):
    log = price_log(spark, sf_dir)
    keys = log.filter("listing_key % 4 = 0").select("listing_key").distinct()
    return snapshot.delete(log, log, keys)[1].groupBy("listing_key").agg(F.count(F.lit(1)).alias("n"))


# Histories


@query(f"""{H}, x AS (SELECT listing_key, arg_min(price, (checked_at, seq)) AS first_price, arg_max(price, (checked_at, seq)) AS last_price, count(*) AS n_prices FROM history GROUP BY listing_key)
  SELECT *, last_price - first_price AS diff, round_even((last_price - first_price) * 100.0e0 / first_price, 1) AS pct, CASE WHEN last_price > first_price THEN 'up' WHEN last_price < first_price THEN 'down' ELSE 'stable' END AS direction FROM x""")
def price_extremes(spark, sf_dir):
    return history.extremes(price_log(spark, sf_dir))


@query(f"{H} SELECT listing_key, seq, change FROM (SELECT *, price - lag(price) OVER (PARTITION BY listing_key ORDER BY checked_at, seq) AS change FROM history) WHERE change < 0")
def price_drops(spark, sf_dir):
    return history.drops(price_log(spark, sf_dir)).select("listing_key", "seq", "change")


@query(f"""{H} SELECT a.listing_key, a.price FROM (SELECT p_partkey AS listing_key, (SELECT arg_max(price, (checked_at, seq)) FROM history h WHERE h.listing_key = p_partkey AND checked_at <= TIMESTAMP '1998-01-01') AS price FROM part) a""")
def price_as_of(spark, sf_dir):
    asks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing_key"), F.lit("1998-01-01").cast("timestamp").alias("at"))
    return history.as_of(price_log(spark, sf_dir), asks).select("listing_key", "price")


@query(f"""{L}, d AS (SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) AS new_price, p_size > 45 AS gone FROM part) SELECT id, CASE WHEN source NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unknown source' WHEN gone THEN 'gone' WHEN new_price IS NULL THEN 'no price' END AS reason,
  source IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND NOT coalesce(gone, false) AND new_price IS NOT NULL AND new_price <> price AS changed FROM listings LEFT JOIN d ON k = id % 5000""")
def saved_price_check(spark, sf_dir):
    detail = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), F.floor("p_retailprice").alias("price"), (F.col("p_size") > 45).alias("gone"))
    saved = all_listings(spark, sf_dir).withColumn("url", (F.col("id") % 5000).cast("string"))
    return history.price_check(saved, detail, ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("id", "reason", "changed")


@query(f"{L} SELECT id, CAST(round_even(CAST(CAST(price * {RATES['rub']}e0 AS VARCHAR) AS DECIMAL(38, 18)), 0) AS DOUBLE) AS price_rub, CAST(round_even(CAST(CAST(price * {RATES['usd']}e0 AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS price_usd FROM listings")
def converted_prices(spark, sf_dir):
    p = F.col("price")
    return all_listings(spark, sf_dir).select("id", numbers.converted(p, F.lit(RATES["rub"])).alias("price_rub"), numbers.converted(p, F.lit(RATES["usd"]), 2).alias("price_usd"))


# Counts and statistics


@query(f"{L} SELECT source, count(*) AS n FROM listings GROUP BY source")
def per_source(spark, sf_dir):
    return stats.per_source(all_listings(spark, sf_dir))


@query(f"{L} SELECT count(*) AS total, count(*) FILTER (WHERE price < 100000) AS shown, count(*) - count(*) FILTER (WHERE price < 100000) AS hidden FROM listings")
def shown_and_hidden(spark, sf_dir):
    return stats.shown_hidden(all_listings(spark, sf_dir), F.col("price") < 100_000)


@query(f"{L} SELECT coalesce(district, CASE WHEN contains(lower(address), 'household') THEN 'HOUSEHOLD' WHEN contains(lower(address), 'machinery') THEN 'MACHINERY' ELSE 'unknown' END) AS district, count(*) AS n FROM listings GROUP BY ALL")
def per_district(spark, sf_dir):
    return stats.per_district(all_listings(spark, sf_dir), ["HOUSEHOLD", "MACHINERY"])


@query(f"{L}, d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM listings) SELECT id, CASE WHEN digits = '' THEN 0 ELSE count(*) OVER (PARTITION BY digits) END AS phone_count FROM d")
def phone_repeats(spark, sf_dir):
    return stats.phone_repeats(all_listings(spark, sf_dir)).select("id", "phone_count")


@query(f"{L} SELECT source, count(*) FILTER (WHERE phone <> '') AS found, count(*) FILTER (WHERE phone = '') AS missing, count(DISTINCT CASE WHEN phone = '' THEN rooms END) AS n_reasons FROM listings GROUP BY source")
def phone_coverage(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("reason", F.when(F.col("rooms").isNotNull(), F.concat(F.lit("r"), F.col("rooms").cast("string"))))
    return stats.phone_coverage(own).select("source", "found", "missing", F.size("reasons").cast("bigint").alias("n_reasons"))


@query("""WITH r AS (SELECT user_id AS source, count(*) FILTER (WHERE event_type = 'view') AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ms, max(CASE WHEN event_type = 'error' AND value > 200 THEN 'x' END) AS error FROM events GROUP BY user_id)
  SELECT count(*) FILTER (WHERE error IS NULL AND n > 0) AS ok, count(*) FILTER (WHERE error IS NULL AND n = 0) AS empty, count(*) FILTER (WHERE error IS NOT NULL) AS failed, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(ms) AS BIGINT) AS ms FROM r""")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("source")).agg(F.count_if(F.col("event_type") == "view").alias("rows"), F.sum(F.floor("value")).alias("ms"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 200), "x")).alias("error"))
    return stats.run_summary(runs)


@query(f"""{L}, b AS (SELECT *, coalesce(CAST(CAST(floor((area - 1) / 15) AS BIGINT) AS VARCHAR), '?') AS bucket FROM listings), g AS (SELECT rooms, district, bucket, median(price) AS m, count(price) AS n FROM b GROUP BY ALL)
  SELECT id, b.bucket, CASE WHEN n >= 3 THEN m ELSE (SELECT median(price) FROM b) END AS threshold, CAST(price <= CASE WHEN n >= 3 THEN m ELSE (SELECT median(price) FROM b) END AS INT) AS good
  FROM b JOIN g ON b.rooms IS NOT DISTINCT FROM g.rooms AND b.district IS NOT DISTINCT FROM g.district AND b.bucket = g.bucket""")
def median_labels(spark, sf_dir):
    return labels.median_label(all_listings(spark, sf_dir)).select("id", "bucket", "threshold", "good")


EXCLUSIVE = """r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS i, count(*) OVER (PARTITION BY k) AS n FROM x), w AS (
  SELECT k, v, i, n, greatest(1, least(n - 1, floor(0.3e0 * (n + 1)))) AS j FROM r), q AS (
  SELECT k, max(n) AS n, sum(v * CASE WHEN n = 1 THEN CASE WHEN i = 1 THEN 1.0e0 ELSE 0.0e0 END WHEN i = j THEN 1 - (0.3e0 * (n + 1) - j) WHEN i = j + 1 THEN 0.3e0 * (n + 1) - j ELSE 0.0e0 END) AS quantile FROM w GROUP BY k)"""


@query(f"{L}, x AS (SELECT concat(source, rooms) AS k, CAST(price AS DOUBLE) AS v FROM listings WHERE price IS NOT NULL AND rooms IS NOT NULL), {EXCLUSIVE} SELECT k AS grp, round(quantile, 4) AS quantile, n FROM q")
def exclusive_quantiles(spark, sf_dir):
    own = all_listings(spark, sf_dir).filter("rooms IS NOT NULL").select(F.concat("source", F.col("rooms").cast("string")).alias("grp"), F.col("price").cast("double").alias("price"))
    return stats.exclusive_quantile(own, ["grp"], "price", 0.3).select("grp", F.round("quantile", 4).alias("quantile"), "n")


KINDS = "x AS (SELECT *, CASE WHEN area IS NOT NULL THEN concat('m2|', coalesce(CAST(rooms AS VARCHAR), '?'), '|', CAST(CAST(floor((area - 1) / 15) AS BIGINT) AS VARCHAR)) ELSE concat('all|', coalesce(CAST(rooms AS VARCHAR), '?'), '|', coalesce(district, '?')) END AS k, CASE WHEN area IS NOT NULL THEN price / area ELSE CAST(price AS DOUBLE) END AS v, area IS NOT NULL AS by_area FROM listings)"


def _quantile_of(rows: str) -> str:
    """The exclusive quantile of 0.3 of rows (k, v), by k."""
    return EXCLUSIVE.replace("FROM x)", f"FROM {rows})")


@query(f"""{L}, {KINDS}, small AS (SELECT k, quantile, n FROM (WITH {_quantile_of("(SELECT k, v FROM x)")} SELECT * FROM q)), whole AS (SELECT k, quantile FROM (WITH {_quantile_of("(SELECT by_area AS k, v FROM x)")} SELECT * FROM q))
  SELECT x.id, CAST(x.v <= CASE WHEN small.n >= 10 THEN small.quantile ELSE whole.quantile END AS INT) AS good, round(CASE WHEN small.n >= 10 THEN small.quantile ELSE whole.quantile END, 4) AS threshold FROM x JOIN small USING (k) JOIN whole ON whole.k = x.by_area""")
def quantile_labels(spark, sf_dir):
    return labels.quantile_label(all_listings(spark, sf_dir)).select("id", "good", F.round("threshold", 4).alias("threshold"))


@query(f"""{L}, f AS (SELECT coalesce(area, (SELECT median(area) FROM listings)) AS area, coalesce(CAST(floor AS DOUBLE), (SELECT median(floor) FROM listings)) AS floor FROM listings)
  SELECT 'area' AS "column", round((SELECT median(area) FROM listings), 4) AS median, round(avg(area), 4) AS mean, round(stddev_pop(area), 4) AS std FROM f UNION ALL SELECT 'floor', round((SELECT median(floor) FROM listings), 4), round(avg(floor), 4), round(stddev_pop(floor), 4) FROM f""")
def column_statistics(spark, sf_dir):
    return stats.column_stats(all_listings(spark, sf_dir), ["area", "floor"]).select("column", *(F.round(c, 4).alias(c) for c in ("median", "mean", "std")))


@query(f"""{L} SELECT 'source' AS "column", lower(trim(source)) AS value, count(*) AS n FROM listings GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT 'district', coalesce(lower(trim(district)), ''), count(*) FROM listings GROUP BY ALL HAVING count(*) >= 2""")
def category_vocabulary(spark, sf_dir):
    return stats.vocabulary(all_listings(spark, sf_dir), ["source", "district"])


@query(f"""{L}, m AS (SELECT source, median(price) AS m FROM listings GROUP BY source) SELECT id, round(price / m, 4) AS source_price_ratio, rooms * area AS rooms_area, round(ln(price), 4) AS log_price FROM listings JOIN m USING (source)""")
def extra_features(spark, sf_dir):
    own = labels.extra_features(all_listings(spark, sf_dir), [])
    return own.select("id", F.round("source_price_ratio", 4).alias("source_price_ratio"), "rooms_area", F.round("log_price", 4).alias("log_price"))


SCORES = "s AS (SELECT l.quality AS good, (d.n_chars % 100) / 100.0e0 AS prob FROM labels l JOIN documents d USING (doc_id))"


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 100) / F.lit(100.0)).alias("prob"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("good"), "prob")


@query(f"""WITH {SCORES}, t AS (SELECT CAST(i AS INT) AS step FROM range(5, 96) g(i)), c AS (SELECT step, count(*) FILTER (WHERE prob >= step / 100.0e0 AND good = 1) AS tp, count(*) FILTER (WHERE prob >= step / 100.0e0 AND good = 0) AS fp,
  count(*) FILTER (WHERE prob < step / 100.0e0 AND good = 1) AS fn, count(*) FILTER (WHERE prob < step / 100.0e0 AND good = 0) AS tn FROM t, s GROUP BY step)
  SELECT step / 100.0e0 AS t, tp, fp, fn, tn, round(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def threshold_table(spark, sf_dir):
    return model.thresholds(_scores(spark, sf_dir)).select("t", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@query(f"""WITH {SCORES}, r AS (SELECT good, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0e0 AS rk FROM s)
  SELECT round((sum(rk) FILTER (WHERE good = 1) - count(*) FILTER (WHERE good = 1) * (count(*) FILTER (WHERE good = 1) + 1) / 2.0e0) / (count(*) FILTER (WHERE good = 1) * count(*) FILTER (WHERE good = 0)), 6) AS auc FROM r""")
def area_under_curve(spark, sf_dir):
    return model.auc(_scores(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 5 AS over_quota FROM events GROUP BY ALL")
def daily_activity(spark, sf_dir):
    return stats.daily_activity(table(spark, sf_dir, "events"), 5)


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def queue_positions(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("requested_at"))
    return stats.queue_positions(own).select("id", F.col("position").cast("bigint").alias("position"))


@query("""WITH f AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS size, sum(CAST(floor(value * 10) AS BIGINT)) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(CAST(floor(value * 10) AS BIGINT)) OVER () AS total FROM events)
  SELECT event_id, total <= 500000 OR upto <= 450000 AS kept FROM f""")
def retained_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("used_at"), F.format_string("%020d", F.lit(10**15) - F.col("event_id")).alias("path"), F.floor(F.col("value") * 10).alias("size"))
    return stats.retained(e, 500_000).select("event_id", "kept")


# Market


@query(f"{L} SELECT rooms, round(avg(price / area), 4) AS mean_per_m2, round(median(price / area), 4) AS median_per_m2, count(price / area) AS n FROM listings GROUP BY rooms")
def rent_per_area(spark, sf_dir):
    own = market.rent_per_area(all_listings(spark, sf_dir), ["rooms"])
    return own.select("rooms", F.round("mean_per_m2", 4).alias("mean_per_m2"), F.round("median_per_m2", 4).alias("median_per_m2"), "n")


@query(f"{H} SELECT listing_key, CAST(max(checked_at) AS DATE) - CAST(min(checked_at) AS DATE) AS days, count(*) AS n FROM history GROUP BY listing_key")
def days_on_market(spark, sf_dir):
    return market.days_on_market(price_log(spark, sf_dir).withColumnRenamed("checked_at", "seen_at"))


@query(f"""{L} SELECT s_suppkey AS org_id, s_name AS name, count(*) AS n, median(price) AS median_price, count(DISTINCT district) AS n_districts, coalesce(string_agg(DISTINCT CAST(rooms AS VARCHAR), ',' ORDER BY CAST(rooms AS VARCHAR)), '') AS kinds, round(avg(area), 4) AS mean_area,
  round(avg(CASE WHEN date_published IS NOT NULL THEN CAST(id % 3 = 0 AS INT) END), 6) AS update_rate FROM listings JOIN supplier ON org = s_suppkey GROUP BY ALL""")
def agency_portfolio(spark, sf_dir):
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("name"))
    rows = all_listings(spark, sf_dir).withColumn("date_updated", F.when(F.col("id") % 3 == 0, F.date_add("date_published", 2)))
    own = market.agency_portfolio(rows.withColumnRenamed("org", "provider_org_id"), orgs)
    return own.withColumns({"mean_area": F.round("mean_area", 4), "update_rate": F.round("update_rate", 6)})


@query(f"""{L}, o AS (SELECT s_suppkey AS org_id, s_name AS name, s_suppkey % 40 AS own, 1000000 + s_suppkey * 7 % 5000 AS a, 1000000 + s_suppkey * 11 % 5000 AS b FROM supplier),
  met AS (SELECT DISTINCT org_id, name, id, price FROM listings JOIN o ON org = org_id OR phone IN ('8 707 ' || a, '8 707 ' || b)) SELECT org_id, name, count(*) AS n, median(price) AS median_price FROM met GROUP BY ALL""")
def portfolio_by_phones(spark, sf_dir):
    """Organizations with the listings that carry their id or one of their numbers."""
    number = lambda by: F.concat(F.lit("+7 (707) "), (F.lit(1000000) + F.col("s_suppkey") * by % 5000).cast("string"))
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("name"), F.array(number(7), number(11), F.lit("no phone"), F.lit(None)).alias("phones"))
    own = market.agency_portfolio(all_listings(spark, sf_dir).withColumnRenamed("org", "provider_org_id"), orgs)
    return own.select("org_id", "name", "n", "median_price")


@query(f"{L} SELECT source, rooms, count(*) AS n, median(price) AS median_price, CAST(grouping(source, rooms) AS BIGINT) AS level FROM listings GROUP BY ROLLUP (source, rooms)")
def market_rollup(spark, sf_dir):
    return market.market_rollup(all_listings(spark, sf_dir), ["source", "rooms"])


@query(f"{L}, m AS (SELECT source, rooms, median(price) AS m FROM listings GROUP BY ALL) SELECT id, round(price / m, 4) AS ratio FROM listings l LEFT JOIN m ON l.source IS NOT DISTINCT FROM m.source AND l.rooms IS NOT DISTINCT FROM m.rooms")
def peer_ratios(spark, sf_dir):
    return market.peer_ratio(all_listings(spark, sf_dir), ["source", "rooms"]).select("id", F.round("ratio", 4).alias("ratio"))


@query(f"""{L}, o AS (SELECT concat(address, '|', rooms) AS fingerprint, url, min(date_published) AS first_seen, max(date_published) AS last_seen FROM listings WHERE rooms IS NOT NULL GROUP BY ALL), w AS (
  SELECT *, lag(url) OVER v AS prev_url, max(last_seen) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_seen FROM o WINDOW v AS (PARTITION BY fingerprint ORDER BY first_seen, url))
  SELECT fingerprint, url, prev_url, CAST(first_seen - prev_seen AS INT) AS gap FROM w WHERE prev_url <> url AND first_seen - prev_seen > 20""")
def reposts(spark, sf_dir):
    own = all_listings(spark, sf_dir).filter("rooms IS NOT NULL").groupBy(F.concat_ws("|", "address", "rooms").alias("fingerprint"), "url").agg(F.min("date_published").alias("first_seen"), F.max("date_published").alias("last_seen"))
    return market.reposts(own, 20)


# Texts, keys and pages


@query(f"{L} SELECT id, left(sha256(concat(source, '|', url, '|', title)), 16) AS listing_key, concat(source, '|', url) AS row_key FROM listings")
def listing_keys(spark, sf_dir):
    s, u, t = F.col("source"), F.col("url"), F.col("title")
    return all_listings(spark, sf_dir).select("id", numbers.listing_key(s, u, t).alias("listing_key"), numbers.row_key(s, u).alias("row_key"))


@query(f"""{L}, d AS (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS s FROM listings) SELECT id, CASE WHEN regexp_full_match(s, '[78][3-9][0-9]{{9}}') THEN concat('+7', right(s, 10)) WHEN regexp_full_match(s, '[3-9][0-9]{{9}}') THEN concat('+7', s) ELSE '' END AS phone FROM d""")
def normalized_phones(spark, sf_dir):
    return all_listings(spark, sf_dir).select("id", phones.normalize_phone(F.col("phone")).alias("phone"))


@query(r"""SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '[0-9]+(?:[.,][0-9]+)?'), ',', '.') AS DOUBLE) AS number, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM documents""")
def text_numbers(spark, sf_dir):
    t = F.col("text")
    words = F.filter(F.split(t, r"[ \t\n\f\r]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", numbers.parse_float(t).alias("number"), F.length(t).cast("bigint").alias("n_chars"), F.size(words).cast("bigint").alias("n_words"))


#: Rules in Latin letters for texts in Latin letters.
LATIN = {"license": "licensed|license", "secret": "token =|password", "table": " | ", "contact": "@mail|.example.com", "shout": "!! |!!"}


@query("SELECT doc_id, " + ", ".join("CAST(" + " OR ".join(f"contains(lower(text), '{p}')" for p in rule.split("|") if p.strip()) + f" AS INT) AS tag_{name}" for name, rule in LATIN.items() if name != "table") + " FROM documents")
def text_tags(spark, sf_dir):
    low = F.lower("text")

    def any_of(rule: str):
        tests = [low.contains(p) for p in rule.split("|") if p.strip()]
        return reduce(lambda a, b: a | b, tests)

    return table(spark, sf_dir, "documents").select("doc_id", *(any_of(r).cast("int").alias(f"tag_{n}") for n, r in LATIN.items() if n != "table"))


def _pattern_sql(pattern: str) -> str:
    """A pattern of tags.py for RE2, whose classes know ASCII alone."""
    letter = r"[\p{L}\p{N}_]"
    return re.sub(r"\\b(?=[a-zа-я])", "(^|[^\\\\p{L}\\\\p{N}_])", pattern.replace(r"\w+\b", r"\w+")).replace(r"\b", r"($|[^\p{L}\p{N}_])").replace(r"[«\"\w]", r"[«\"\p{L}\p{N}_]").replace(r"\w", letter)


def _holds_sql(phrases: list[str], pattern: str | None) -> str:
    return "(" + " OR ".join([*(f"contains(low, '{p}')" for p in phrases), *([f"regexp_matches(low, '{_pattern_sql(pattern)}')"] if pattern else [])]) + ")"


def _graded_sql(rules: list) -> str:
    return "CASE " + " ".join(f"WHEN {_holds_sql(phrases, pattern)} THEN {value!r}" for value, phrases, pattern in rules) + " END"


def _features_sql() -> str:
    plain = [n.removeprefix("tag_") for n in tags.NAMES[: len(tags.TAGS)]]
    tagged = ", ".join(f"CAST({_holds_sql(tags.TAGS[t], tags.PATTERNS.get(t))} AS INT) AS tag_{t}" for t in plain)
    known = {"price", "rooms", "area", "floor", "total_floors", "district", "quality_score", "source"}
    made = {
        "price_per_m2": "round_even(nullif(price, 0) / nullif(area, 0), 1)", "price_per_room": "round_even(nullif(price, 0) / nullif(rooms, 0), 1)", "floor_ratio": "round_even(nullif(floor, 0) / nullif(total_floors, 0), 2)",
        "is_first_floor": "CAST(coalesce(floor = 1, false) AS INT)", "is_last_floor": "CAST(coalesce(floor = total_floors AND floor <> 0, false) AS INT)", "deal_type": "'long_term'", "listing_type": "'WHOLE_APARTMENT'", "n_photos": "1", "has_photo": "1",
        "desc_length": "length(coalesce(text, ''))", "desc_words": r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))", "furnished": "id % 2 = 0", "children_allowed": "true",
    }
    base = ", ".join(c if c in known else f"{made.get(c, 'NULL')} AS {c}" for c in labels.BASE)
    ends = {"tag_euro_renovation": "renovation_grade = 3", "tag_needs_repair": "renovation_grade = 0", "tag_fully_furnished": "said = 'full'", "tag_partial_furnished": "said = 'partial'", "tag_unfurnished": "said = 'none'"}
    listed = ", ".join([*(f"CASE WHEN tag_{t} = 1 THEN '{t}' END" for t in plain), *(f"CASE WHEN {test} THEN '{n.removeprefix('tag_')}' END" for n, test in ends.items())])
    shown = [f"tag_{t}" for t in plain if t != "long_term"] + ["1 AS tag_long_term"] + [f"CAST(coalesce({test}, false){' OR id % 2 = 0' if n == 'tag_fully_furnished' else ''} AS INT) AS {n}" for n, test in ends.items()]
    year = f"nullif(regexp_extract(low, '{_pattern_sql(r'(?:дом|построен\w*|постройки|сдан\w*|год)\s*[:,]?\s*((?:19|20)[0-9]{2})')}', 1), '')"
    height = f"TRY_CAST(replace(nullif(regexp_extract(low, '{_pattern_sql(r'потолк\w*\s*(?:—|–|-|:)?\s*([0-9](?:[.,][0-9])?)\s*(?:м\b|метр)')}', 1), ''), ',', '.') AS DOUBLE)"
    return rf"""{L}, t AS (SELECT l.*, d.text, lower(concat(coalesce(title, ''), ' ', coalesce(d.text, ''))) AS low FROM listings l JOIN documents d ON doc_id = id), g AS (
      SELECT *, TRY_CAST(coalesce({year}, nullif(regexp_extract(low, '((?:19|20)[0-9]{{2}})\s*года?\s*(?:постройки|сдачи)', 1), '')) AS INT) AS year_built, {height} AS ceiling_height, {_graded_sql(tags.RENOVATION)} AS renovation_grade, {_graded_sql(tags.FURNITURE)} AS said, {_graded_sql(tags.BUILDING)} AS building_type, {tagged} FROM t
    ), f AS (SELECT *, coalesce(said, CASE WHEN id % 2 = 0 THEN 'full' END) AS furniture_level FROM g)
    SELECT {base}, year_built, ceiling_height, renovation_grade, furniture_level, CASE furniture_level WHEN 'none' THEN 0 WHEN 'partial' THEN 1 WHEN 'full' THEN 2 END AS furniture_grade, building_type,
      CASE {" ".join(f"WHEN tag_{tag} = 1 THEN '{kind}'" for kind, tag in tags.BATHROOM.items())} END AS bathroom_type, {", ".join(shown)}, concat_ws('|', {listed}, 'children_ok') AS tag_list, concat(source, '|', url) AS row_key, url, title FROM f"""


@query(_features_sql())
def feature_rows(spark, sf_dir):
    """All features of all listings, with texts from documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    own = all_listings(spark, sf_dir).join(d, "id").withColumns({"photos": F.array(F.col("url")), "furnished": F.col("id") % 2 == 0, "pets_allowed": F.lit(None).cast("boolean"), "children_allowed": F.lit(True), "listing_type": F.lit("WHOLE_APARTMENT"), "deal_type": F.lit("long_term")})
    return labels.feature_rows(own)


@query()
def message_fields(spark, sf_dir):
    """The message reader's fields over all documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return texts.fields(rows).drop("text")


@query(r"""SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n_links, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') AS base_url FROM pages""")
def page_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "<title[^>]*>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]+)"'), 1)).cast("bigint").alias("n_links"),
        F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"), pages.base_url(F.col("url")).alias("base_url"),
    )


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]+">[^<]*</a>')) AS card, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]+">[^<]*</a>'), 1) - 1 AS card_no FROM pages)
  SELECT page_id, CAST(card_no AS INT) AS card_no, CASE WHEN starts_with(regexp_extract(card, 'href="([^"]+)"', 1), '/') THEN 'https://s.test' ELSE '' END || regexp_extract(card, 'href="([^"]+)"', 1) AS url FROM c WHERE regexp_extract(card, '>([^<>]+)</a>', 1) <> ''""")
def page_cards(spark, sf_dir):
    site = pages.Site("s", "https://s.test", r"(<li><a href=\"[^\"]+\">[^<]*</a>)", {"url": r"href=\"([^\"]+)\"", "title": r">([^<>]+)</a>"})
    return pages.cards(table(spark, sf_dir, "pages"), site).select("page_id", "card_no", "url")


#: Pages of cards as each source builds them; {…} are columns of a listing. Prices and addresses are in nested elements.
SITE_CARDS = {
    "krisha": """<div class="a-card big"><div><div class="x"><a class="a-card__title" href="/a/show/{id}">{title}</a></div><p>text<p>more</div><div class="a-card__price"><div><b>{price}</b></div><div>〒<br></div></div><!-- <div class="a-card__price">1</div> -->
      <div class="a-card__subtitle"><div>{nation},</div><div>{segment}</div></div>{inner}</div>""",
    "olx": """<div data-cy="l-card"><a href="/d/obyavlenie/{id}"><img src="i.jpg"></a><div data-testid="ad-card-title"><div><a href='/d/obyavlenie/{id}'><h4>{title}</h4></a></div></div><p data-testid="ad-price"><span><i>{price}</i></span><span>тг</span></p>
      <div data-testid="location-date"><div>{nation}, {segment}</div> - <div>Сегодня в 14:32</div></div>{inner}</div>""",
    "kn": """<div class="row kn-shadow-hover-2"><script>var a = '<div data-object-id="0"></div>';</script><a href="/card/{id}">16 фото</a><div><a href="/card/{id}"><div><b class="t">{title}</b></div></a></div><span><span><b>{price}</b></span> <i>₸</i></span>{inner}</div>""",
    "etagi": """<section><div data-testid="object_card"><div><a href="/realty_rent/{id}/"></a><a class="card-title" href="/realty_rent/{id}/"><span>{title}</span></a></div><div data-testid="object_card_price"><div>{price}</div><div>₸</div></div><div class="address"><div>{nation},</div> <div>{segment}</div></div>{inner}</div></section>""",
}
SITE_URLS = {"krisha": "https://krisha.kz/a/show/", "olx": "https://www.olx.kz/d/obyavlenie/", "kn": "https://www.kn.kz/card/", "etagi": "https://almaty.etagi.com/realty_rent/"}


@query(f"""WITH c AS (SELECT o_orderkey AS id, ['krisha', 'olx', 'kn', 'etagi'][o_custkey % 4 + 1] AS source, CAST(floor(o_totalprice) AS BIGINT) + 1000 AS price, o_orderstatus AS clerk, o_orderpriority AS priority FROM orders)
  SELECT source, CASE source {' '.join(f"WHEN '{k}' THEN '{u}'" for k, u in SITE_URLS.items())} END || id || CASE source WHEN 'etagi' THEN '/' ELSE '' END AS url, 'Listing ' || id || ' of many' AS title, price, CASE source WHEN 'kn' THEN '' ELSE clerk || ', ' || priority END AS address FROM c
  UNION ALL SELECT source, 'https://krisha.kz/a/inner/' || id, 'Inner', NULL, '' FROM c WHERE source = 'krisha' AND id % 5 = 0""")
def cards_of_sites(spark, sf_dir):
    """Listings of all four sources read from pages of twenty cards each. Some of krisha's cards hold another card."""
    names = [*SITE_CARDS]
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 4 AS k", "CAST(floor(o_totalprice) AS BIGINT) + 1000 AS price", "concat('Listing ', o_orderkey, ' of many') AS title", "o_orderstatus AS nation", "o_orderpriority AS segment")
    inner = F.when((F.col("k") == 0) & (F.col("id") % 5 == 0), F.concat(F.lit('<div class="a-card"><a class="a-card__title" href="/a/inner/'), "id", F.lit('"><b>Inner</b></a></div>'))).otherwise("")
    rows = rows.withColumn("inner", inner)
    filled = lambda html: F.concat(*(F.col(x[1:-1]).cast("string") if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", html) if x))
    card = reduce(lambda c, k: c.when(F.col("k") == k, filled(SITE_CARDS[names[k]])), range(1, 4), F.when(F.col("k") == 0, filled(SITE_CARDS[names[0]])))
    made = rows.groupBy("k", F.floor(F.col("id") / 80).alias("page_id")).agg(F.concat(F.lit("<html><body><div>"), F.array_join(F.collect_list(card), " "), F.lit("</body>")).alias("html"))
    today = F.lit("2024-08-15").cast("date")
    read = [sites.listings(made.filter(F.col("k") == k), sites.SITES[n], today) for k, n in enumerate(names)]
    return reduce(DataFrame.unionByName, read).select("source", "url", "title", "price", "address")


@query()
def page_phones(spark, sf_dir):
    """Contact number of each page and the stage that found it."""
    return table(spark, sf_dir, "pages").select("page_id", phones.contact_phone(F.col("html")).alias("p")).select("page_id", "p.phone", "p.stage")


@query()
def page_details(spark, sf_dir):
    return pages.detail_fields(table(spark, sf_dir, "pages"))


@query("""SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS BIGINT) AS k FROM events""")
def event_states(spark, sf_dir):
    """The number kept in each event's JSON."""
    v = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"))


# Texts made of known fields, so that what is read out of them is known

MONTH_WORDS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS by_words, CAST(o_orderdate AS DATE) AS by_dots, CAST(o_orderdate AS DATE) AS by_iso, CAST(o_orderdate AS DATE) AS updated, DATE '1990-02-01' AS published FROM orders")
def dates_in_texts(spark, sf_dir):
    on = F.to_date("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, MONTH_WORDS)), F.month(on))
    today = F.lit("2024-08-15").cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.day(on).cast("string"), month, F.year(on).cast("string")).alias("words"), F.date_format(on, "dd.MM.yyyy").alias("dots"), F.date_format(on, "yyyy-MM-dd").alias("iso"))
    read = lambda c: dates.parse_date(F.col(c), today)
    both = dates.extract_dates(F.concat(F.lit("обновлено "), "dots", F.lit(", 01.02.1990")), today)
    return rows.select("id", read("words").alias("by_words"), read("dots").alias("by_dots"), read("iso").alias("by_iso"), both["updated"].alias("updated"), both["published"].alias("published"))


@query(f"""{L} SELECT id, CASE WHEN price >= 30000 THEN price END AS price, rooms, area, floor, CASE WHEN floor IS NOT NULL AND floor <= total_floors THEN total_floors END AS total_floors, 'WHOLE_APARTMENT' AS listing_type, address FROM listings""")
def offers_read_back(spark, sf_dir):
    own = all_listings(spark, sf_dir)
    part = lambda c, *bits: F.when(F.col(c).isNotNull(), F.concat(*(F.lit(b) if isinstance(b, str) else b for b in bits))).otherwise("")
    s = lambda c: F.col(c).cast("string")
    text = F.concat(part("rooms", F.when(F.col("rooms") == 0, "студия").otherwise(F.concat(s("rooms"), F.lit("-комнатная"))), " "), F.lit("квартира, "), s("price"), F.lit(" тг; "), part("area", s("area"), " м²; "), part("floor", s("floor"), "/", s("total_floors"), " этаж; "), F.lit("адрес: "), "address")
    t = F.col("text")
    rows = own.select("id", text.alias("text"))
    return rows.select("id", texts.rent_price(t).alias("price"), texts.rooms_in_text(t).alias("rooms"), texts.area_in_text(t).alias("area"), texts.floor_in_text(t)["floor"].alias("floor"), texts.floor_in_text(t)["total"].alias("total_floors"), texts.listing_type(t).alias("listing_type"), texts.address_in_text(t).alias("address"))


@query(f"""{L} SELECT id, price, CAST(rooms AS INT) AS rooms, floor, CASE WHEN floor IS NOT NULL THEN total_floors END AS total_floors, area, id % 1000 * 1000 AS views, CASE WHEN rooms = 0 THEN 'студия' WHEN rooms IS NOT NULL THEN concat(rooms, '-комн.') END AS label FROM listings""")
def numbers_read_back(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    pair = numbers.parse_floor_pair(F.concat_ws("/", F.when(F.col("floor").isNotNull(), s("floor")), F.when(F.col("floor").isNotNull(), s("total_floors"))))
    return all_listings(spark, sf_dir).select(
        "id", numbers.parse_int(F.concat(numbers.grouped(F.col("price")), F.lit(" тг"))).alias("price"),
        numbers.parse_rooms(F.when(F.col("rooms") == 0, "студия").otherwise(F.concat(s("rooms"), F.lit(" комн.")))).alias("rooms"),
        pair["floor"].alias("floor"), pair["total"].alias("total_floors"), numbers.lenient_double(F.concat(F.lit(" "), F.replace(s("area"), F.lit("."), F.lit(",")))).alias("area"),
        numbers.view_count(F.concat((F.col("id") % 1000).cast("string"), F.lit("K"))).alias("views"), numbers.room_label(F.col("rooms")).alias("label"),
    )


@query(f"""{L}, h AS (SELECT id, greatest(0, date_diff('hour', date_published::TIMESTAMP, TIMESTAMP '1998-06-08 00:00:00')) AS h FROM listings)
  SELECT id, CASE WHEN h <= 2 THEN 1.0e0 WHEN h <= 6 THEN 0.95e0 WHEN h <= 12 THEN 0.9e0 WHEN h <= 24 THEN 0.8e0 WHEN h <= 48 THEN 0.6e0 WHEN h <= 168 THEN 0.3e0 ELSE 0.1e0 END AS freshness FROM h""")
def freshness_scores(spark, sf_dir):
    as_of = F.lit("1998-06-08 00:00:00").cast("timestamp")
    return all_listings(spark, sf_dir).select("id", texts.freshness(F.col("date_published").cast("timestamp"), as_of).alias("freshness"))


@query(f"""{L} SELECT id, CAST(greatest(0, least(100, 20 + 15 + CASE WHEN area IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN rooms IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN phone <> '' THEN 5 ELSE 0 END
  + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END - CASE WHEN id % 5 = 0 THEN 20 ELSE 0 END)) AS INT) AS quality FROM listings""")
def quality_scores(spark, sf_dir):
    none = F.lit(None).cast("string")
    own = {"photo": F.when(F.col("id") % 3 == 0, "http://p"), "owner_probability": F.when(F.col("id") % 5 == 0, 0.15).otherwise(0.5), "deposit": none.cast("int"), "utilities": F.lit("unknown")}
    score = texts.quality_score(lambda c: own[c] if c in own else F.col(c) if c in ("price", "lat", "lon", "area", "rooms", "phone", "address") else none)
    return all_listings(spark, sf_dir).select("id", score.alias("quality"))


@query(f"""{L} SELECT id, CASE id % 4 WHEN 0 THEN 0.85e0 WHEN 1 THEN 0.15e0 ELSE 0.5e0 END AS owner FROM listings""")
def owner_scores(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ["я собственник", "агентство, комиссия 50%", "собственник, услуги агентства", "квартира"])), (F.col("id") % 4 + 1).cast("int"))
    return all_listings(spark, sf_dir).select("id", texts.owner_probability(text).alias("owner"))


@query(f"""{L} SELECT id, CAST(50000 + id % 100000 AS BIGINT) AS deposit, CASE WHEN id % 3 = 0 THEN true END AS deposit_refundable, CASE WHEN id % 2 = 0 THEN CAST(1 + id % 90 AS INT) END AS commission_percent,
  CASE WHEN id % 2 = 1 THEN CAST(20000 + id % 500 AS BIGINT) END AS commission_fixed, CASE id % 4 WHEN 0 THEN 'unknown' WHEN 3 THEN 'included' ELSE 'separate' END AS utilities, CASE WHEN id % 4 = 2 THEN CAST(15000 AS BIGINT) END AS utilities_min,
  CASE WHEN id % 4 = 2 THEN CAST(25000 + id % 100 AS BIGINT) END AS utilities_max, id % 5 = 0 AS price_per_person, CAST(120000 + id % 1000 AS BIGINT) AS first_payment FROM listings""")
def costs_read_back(spark, sf_dir):
    n = lambda c: c.cast("string")
    k = F.col("id")
    apart = F.lit("; просторно, светло, чисто, тихо и уютно, соседи хорошие; ")
    utilities = F.when(k % 4 == 1, "коммунальные 15000").when(k % 4 == 2, F.concat(F.lit("коммунальные 15000-"), n(25_000 + k % 100), F.lit(" тг"))).when(k % 4 == 3, "коммунальные 9000-12000, всё включено").otherwise("")
    text = F.concat(
        F.lit("депозит "), n(50_000 + k % 100_000), F.lit(" тг"), F.when(k % 3 == 0, ", возвратный").otherwise(""), apart, F.lit("комиссия "), F.when(k % 2 == 0, F.concat(n(1 + k % 90), F.lit("%"))).otherwise(F.concat(n(20_000 + k % 500), F.lit(" тенге"))),
        apart, F.lit("первый взнос, заезд "), n(120_000 + k % 1000), F.lit(" тг"), apart, utilities, apart, F.when(k % 5 == 0, "45 000 с человека").otherwise("45 000"),
    )
    return all_listings(spark, sf_dir).select("id", texts.costs(text).alias("c")).select("id", "c.*")


# More tables and reports


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '00000007')")
def organizations_by_text(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").withColumn("address", F.lit(None).cast("string"))
    return filters.organizations_matching(own, "R#00000007"[2:], ("s_name", "address")).select("s_suppkey")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def saved_by_rating(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("rating"), (-F.col("s_suppkey")).alias("updated_at"))
    return filters.by_rating(own).limit(50).select("s_suppkey", "s_name")


@query(f"WITH {SCORES}, p AS (SELECT d.doc_id, (d.n_chars % 100) / 100.0e0 AS prob FROM documents d) SELECT doc_id, prob, CASE WHEN prob >= 0.5 THEN 'good' WHEN prob <= 0.3 THEN 'expensive' ELSE 'arguable' END AS verdict FROM p ORDER BY prob DESC, doc_id LIMIT 100")
def top_deals(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 100) / F.lit(100.0)).alias("prob"), F.format_string("%020d", "doc_id").alias("url"))
    return filters.top_deals(own, 100).select("doc_id", "prob", model.verdict(F.col("prob"), 0.4).alias("verdict"))


@query("SELECT event_id AS id FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 50")
def newest_open(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("closed"))
    return filters.newest(own, 50).select("id")


@query(r"""SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1), lambda u: regexp_matches(u, '^https?://')))) AS BIGINT) AS n_urls FROM pages""")
def unique_urls(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]+)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(files.unique_urls(links)).cast("bigint").alias("n_urls"))


@query("SELECT concat('u/', user_id) AS url, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00'")
def fresh_copies(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").cast("string").alias("html"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return pages.fresh_copy(own, F.lit("2024-01-31 00:00:00").cast("timestamp"), 43_200).select("url", F.col("html").cast("bigint").alias("event_id"))


@query(r"""SELECT page_id, regexp_matches(lower(concat_ws(' ', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))), 'thea|chen') AS category FROM pages""")
def category_guard(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.is_category_page(F.col("html"), "thea|chen").alias("category"))


@query(f"""{L}, c AS (SELECT regexp_replace(url, '/+$', '') AS b, min(price) AS p FROM listings GROUP BY 1), d AS (SELECT p_partkey, p_size, concat('https://s.test/a/', p_partkey, CASE p_partkey % 3 WHEN 1 THEN '/photos/2' ELSE '' END) AS b FROM part),
  m AS (SELECT p_partkey, max_by(p, (d.b = c.b, least(length(d.b), length(c.b)), -p)) AS p FROM d JOIN c ON d.b = c.b OR starts_with(d.b, concat(c.b, '/')) OR starts_with(c.b, concat(d.b, '/')) GROUP BY p_partkey)
  SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE p END AS price FROM d LEFT JOIN m USING (p_partkey)""")
def matched_cards(spark, sf_dir):
    key = F.col("p_partkey")
    url = F.concat(F.lit("https://s.test/a/"), key.cast("string"), F.when(key % 3 == 1, "/photos/2/").otherwise("/"), F.lit("?from=x"))
    d = table(spark, sf_dir, "part").select(key.alias("page_id"), url.alias("url"), F.when(key % 2 == 0, F.col("p_size").cast("bigint")).alias("price"))
    return pages.match_cards(d, all_listings(spark, sf_dir).select("url", "price")).select("page_id", "price")


@query(f"WITH {SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE prob >= 0.4e0 + 0.1e0) AS good, round(count(*) FILTER (WHERE prob >= 0.4e0 + 0.1e0) / count(*), 6) AS share FROM s")
def share_of_good(spark, sf_dir):
    return filters.good_share(_scores(spark, sf_dir), 0.4).withColumn("share", F.round("share", 6))


#: Phrases of listings, and the tags that each sets.
SAMPLES = [
    ("новостройка, сдан в эксплуатацию", "new_building"), ("вторичный рынок", "secondary"), ("уютная студия", "studio"), ("пентхаус", "apartments"), ("евро планировка", "euro_layout"), ("есть балконы", "balcony"), ("застеклённая лоджия", "loggia"),
    ("дв санузла и 2 с/у", "two_bathrooms"), ("раздельный санузел", "separated_bathroom"), ("совмещенный с/у", "combined_bathroom"), ("душевая кабина", "shower"), ("чугунная ванна", "bath"), ("стиральная машина", "washer"), ("новый холодильник", "fridge"),
    ("сплит система", "ac"), ("посудомоечная машина", "dishwasher"), ("smart tv", "tv"), ("плита газовая", "oven"), ("микроволновка", "microwave"), ("быстрый интернет", "internet"), ("вай-фай", "wifi"), ("умный замок", "smart_lock"), ("счётчики", "counters"),
    ("автономное отопление", "autonomous_heating"), ("центральное отопление", "central_heating"), ("вода включена", "water_included"), ("бойлер", "boiler"), ("подземная парковка", "parking"), ("гараж", "garage"), ("охрана", "security"), ("консьерж", "concierge"),
    ("видеонаблюдение", "cctv"), ("закрытый двор", "closed_yard"), ("детская площадка", "playground"), ("лифт", "elevator"), ("грузовой лифт", "elevator|freight_elevator"), ("тренажерный зал", "gym"), ("вид на горы", "view_mountains"), ("вид на парк", "view_park"),
    ("панорамные окна", "panoramic"), ("угловая квартира", "corner"), ("метро", "near_metro"), ("рядом школа", "near_school"), ("около садика", "near_kindergarten"), ("рядом сквер", "near_park"), ("рядом рынок", "near_shop"), ("срочно", "urgent"), ("торг", "bargain"),
    ("без комиссии", "no_commission"), ("без посредников", "no_agency"), ("хозяин", "owner"), ("долгосрочно", "urgent|long_term"), ("посуточно", "daily"), ("для семьи", "for_family"), ("студентам", "for_students"), ("техника есть", "appliances_included"),
    ("тихий двор", "quiet_yard"), ("элитный дом", "prestige"), ("свежий ремонт", "euro_renovation"), ("нужен ремонт", "needs_repair"), ("вся мебель", "fully_furnished"), ("минимум мебели", "partial_furnished"), ("без мебели", "unfurnished"), ("лифты и торговый дом", ""),
]


@query(f"""{L}, s(k, tags) AS (VALUES {", ".join(f"({k}, '{t}')" for k, (_, t) in enumerate(SAMPLES))}) SELECT id, CASE WHEN id % 5 = 0 THEN 1990 + id % 30 END AS year_built, s.tags,
  CASE s.tags WHEN 'euro_renovation' THEN 3 WHEN 'needs_repair' THEN 0 END AS renovation_grade, CASE s.tags WHEN 'fully_furnished' THEN 'full' WHEN 'partial_furnished' THEN 'partial' WHEN 'unfurnished' THEN 'none' END AS furniture_level FROM listings JOIN s ON id % {len(SAMPLES)} = k""")
def tags_read_back(spark, sf_dir):
    k = F.col("id")
    text = F.concat(F.element_at(F.array(*(F.lit(t) for t, _ in SAMPLES)), (k % len(SAMPLES) + 1).cast("int")), F.when(k % 5 == 0, F.concat(F.lit("; построен "), (1990 + k % 30).cast("string"))).otherwise(""))
    own = tags.with_tags(all_listings(spark, sf_dir).select("id", F.lit("Сдаётся").alias("title"), text.alias("description")))
    return own.select("id", F.col("year_built").cast("bigint").alias("year_built"), tags.tag_list(tags.NAMES).alias("tags"), "renovation_grade", "furniture_level")


KAZAKH = ["2 бөлмелі пәтер жалға беріледі", "депозит жоқ, жаңа ремонт", "әр айға 150 мың теңге", "қыздарға керек емес", "үлкен көше жанында, даңғыл жақын", "үй 5 қабатта"]


def _translated_sql(text: str) -> str:
    return reduce(lambda t, word: f"replace({t}, '{word}', '{texts.GLOSSARY[word]}')", texts.BY_LENGTH, text)


@query(f"{L}, k(n, words) AS (VALUES {', '.join(f"({n}, '{w}')" for n, w in enumerate(KAZAKH))}) SELECT id, {_translated_sql("concat(words, ', ', address)")} AS text FROM listings JOIN k ON id % {len(KAZAKH)} = n")
def translated_texts(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, KAZAKH)), (F.col("id") % len(KAZAKH) + 1).cast("int"))
    return all_listings(spark, sf_dir).select("id", texts.translated(F.concat(words, F.lit(", "), "address")).alias("text"))


@query(f"{L} SELECT title, median(price) AS median_price, count(price) AS n FROM listings GROUP BY title HAVING count(price) >= 5")
def median_per_complex(spark, sf_dir):
    return market.median_by(all_listings(spark, sf_dir), ["title"], least=5)


@query(f"{H} SELECT listing_key, string_agg(CAST(price AS VARCHAR), ',' ORDER BY checked_at, price) AS prices FROM history GROUP BY listing_key")
def nested_series(spark, sf_dir):
    return history.nested(price_log(spark, sf_dir)).select("listing_key", F.array_join(F.transform("series", lambda p: p["price"].cast("string")), ",").alias("prices"))


@query(f"{L} SELECT CAST(row_number() OVER (ORDER BY price DESC, id) AS INT) AS n, id, concat(title, '; ', coalesce(CAST(rooms AS VARCHAR), '—')) AS head FROM listings ORDER BY price DESC, id LIMIT 20")
def report_of_top(spark, sf_dir):
    top = all_listings(spark, sf_dir).orderBy(F.desc("price"), "id").limit(20)
    blocks = files.report_blocks(top, [F.desc("price"), F.col("id")]).join(top.select("id", F.row_number().over(_by_price()).alias("n")), "n")
    lines = F.split("block", "\n")
    return blocks.select("n", "id", F.concat(F.regexp_replace(lines[0], r"^[0-9]+\. ", ""), F.lit("; "), F.regexp_extract(lines[2], "rooms: ([^,]+)", 1)).alias("head"))


def _by_price():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("price"), "id")  # over a top list


@query(f"{L} SELECT id, CASE WHEN contains(lower(address), 'nation_1,') THEN 'One' WHEN contains(lower(address), 'machinery') THEN 'Machines' WHEN contains(lower(address), 'nation_2') THEN 'Two' END AS name FROM listings")
def dictionary_names(spark, sf_dir):
    index = spark.createDataFrame([("machinery", "Machines", 2), ("NATION_1,", "One", 1), ("nation_2", "Two", 3)], "fragment string, name string, position int")
    return geo.lookup_names(all_listings(spark, sf_dir), F.col("address"), index).select("id", "name")


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderpriority AS name, (o_orderkey * 7919) % 100003 AS p FROM orders), l AS (SELECT *, row_number() OVER () AS r FROM lineitem), t AS (SELECT r, l_orderkey, l_linenumber, unnest([l_orderkey, l_orderkey + 1, l_partkey]) AS k FROM l)
  SELECT l_orderkey, l_linenumber, min_by(name, (p, 'order ' || d.k || ';')) AS name FROM t LEFT JOIN d USING (k) GROUP BY r, l_orderkey, l_linenumber""")
def large_dictionary(spark, sf_dir):
    """Each line item's note looked up in a dictionary with a fragment for every order."""
    key = lambda c: F.concat(F.lit(" ORDER "), c.cast("string"), F.lit(";"))
    index = table(spark, sf_dir, "orders").select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(";")).alias("fragment"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") * 7919 % 100003).alias("position"))
    notes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Note:"), key(F.col("l_orderkey")), key(F.col("l_orderkey") + 1), key(F.col("l_partkey"))).alias("note"))
    return geo.lookup_names(notes, F.col("note"), index).drop("note")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'bad' ELSE 'row' END AS kind, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_custkey END) AS BIGINT) AS prices FROM orders GROUP BY ALL""")
def rows_kept_apart(spark, sf_dir):
    """Records written as JSON lines, every seventh with a price that is no number and every eleventh cut short, and read back."""
    key, path = F.col("o_orderkey"), fresh_path(spark, "lines")
    whole = F.to_json(F.struct(key.alias("id"), F.when(key % 7 == 0, F.lit("12 or so")).otherwise(F.col("o_custkey").cast("string")).alias("price")))
    line = F.regexp_replace(whole, r'"price":"([0-9]+)"', '"price":$1')
    table(spark, sf_dir, "orders").select(F.when(key % 11 == 0, F.substring(line, 1, 12)).otherwise(line)).write.text(path)
    rows, bad, _ = files.read_checked(spark, path, "id long, price long")
    return rows.agg(F.lit("row").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("prices")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("prices")))


@query(f"{L} SELECT source, count(*) AS n, count(rooms) AS with_rooms FROM (SELECT source, rooms FROM listings UNION ALL SELECT s_name, NULL FROM supplier) GROUP BY source")
def union_of_sources(spark, sf_dir):
    other = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.col("s_suppkey").alias("id"))
    both = snapshot.union_sources(all_listings(spark, sf_dir), other)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("rooms").alias("with_rooms"))


# Small functions read back from values made of known parts


@query(f"""{H}, e AS (SELECT listing_key, min_by(price, (checked_at, seq)) AS first_price, max_by(price, (checked_at, seq)) AS last_price, count(*) AS n_prices FROM history GROUP BY 1)
  SELECT p_partkey AS listing_key, first_price, last_price, n_prices, last_price - first_price AS diff FROM part LEFT JOIN e ON p_partkey = listing_key""")
def saved_with_extremes(spark, sf_dir):
    saved = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing_key"))
    return history.with_extremes(saved, price_log(spark, sf_dir)).select("listing_key", "first_price", "last_price", "n_prices", "diff")


@query(f"""{L} SELECT id, CASE WHEN phone IN (SELECT '8 707 ' || (1000000 + s_suppkey * 7 % 5000) FROM supplier) THEN '' ELSE phone END AS phone FROM listings""")
def barred_numbers(spark, sf_dir):
    barred = table(spark, sf_dir, "supplier").select(F.concat(F.lit("+7-707-"), (F.lit(1000000) + F.col("s_suppkey") * 7 % 5000).cast("string")).alias("phone"))
    return phones.without_barred(all_listings(spark, sf_dir).select("id", "phone"), barred)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('8707', 1000000 + o_custkey, ',7705', 2000000 + o_custkey) WHEN 1 THEN concat('7', 1000000000 + o_orderkey) ELSE '' END AS phones FROM orders""")
def numbers_in_records(spark, sf_dir):
    """Phones in nested JSON: under keys that say so, else any number that could be one."""
    k, own = F.col("o_orderkey"), F.col("o_custkey").cast("long")
    named = F.to_json(F.struct((F.lit(71000000000) + k).alias("id"), F.struct(F.array(F.struct(F.concat(F.lit("8 707 "), (own + 1000000).cast("string")).alias("n"), (F.lit(77050000000) + own + 2000000).alias("m"))).alias("Phones")).alias("seller")))
    plain = F.to_json(F.struct(F.concat(F.lit("7"), (F.lit(1000000000) + k).cast("string")).alias("ref"), F.lit("12").alias("room")))
    record = F.when(k % 3 == 0, named).when(k % 3 == 1, plain).otherwise(F.lit('{"a": [1, {"b": null}]}'))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(phones.phones_in_json(record), ",").alias("phones"))


@query("""SELECT o_orderkey AS id, CAST(1000000 + o_orderkey AS VARCHAR) AS ad FROM orders""")
def advert_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (F.lit(1000000) + k).cast("string")
    html = F.when(k % 4 == 0, F.concat(F.lit('<a href="/promote/?x=1&id='), n, F.lit('"> "sku": "999999999"'))).when(k % 4 == 1, F.concat(F.lit('{"sku" : "'), n, F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit('<i data-ad-id="'), n, F.lit('">'))).otherwise("none 12345")
    return table(spark, sf_dir, "orders").select(k.alias("id"), numbers.ad_id(html, F.concat(F.lit("https://s.test/a/show/"), n)).alias("ad"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def provider_dates(spark, sf_dir):
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    said = F.when(k % 3 == 0, F.concat(F.date_format(on, "yyyy-MM-dd"), F.lit("T10:20:30.123Z"))).when(k % 3 == 1, F.unix_seconds(on.cast("timestamp")).cast("string")).otherwise("soon")
    # From March 1973 on, seconds have nine digits or more.
    return table(spark, sf_dir, "orders").select(k.alias("id"), dates.provider_date(said).cast("date").alias("day"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat(1 + o_custkey % 28, ' мая') WHEN 1 THEN 'срочно/сегодня' ELSE '' END AS available FROM orders""")
def availability(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Сдам квартиру с  "), (1 + F.col("o_custkey") % 28).cast("string"), F.lit(" мая, срочно"))).when(k % 3 == 1, "Срочно сдам, торг").otherwise("Сдам квартиру")
    return table(spark, sf_dir, "orders").select(k.alias("id"), texts.available_from(text).alias("available"))


@query("""SELECT c_custkey AS id, concat('+7707', 1000000 + c_custkey) AS whatsapp, concat('user_', c_custkey + 10000) AS chat, concat('https://2gis.kz/almaty/firm/', c_custkey + 7000, '?m=76.5,43.25') AS url, CAST(c_custkey + 7000 AS VARCHAR) AS object_id FROM customer""")
def contacts_in_posts(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    text = F.concat(F.lit("Пишите: wa.me/7707"), (k + 1000000).cast("string"), F.lit(" или @user_"), (k + 10000).cast("string"), F.lit(", a@b.kz. Тут: https://2gis.kz/almaty/firm/"), (k + 7000).cast("string"), F.lit("?m=76.5,43.25 рядом"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), phones.whatsapp(text).alias("whatsapp"), phones.chat_handle(text).alias("chat"), phones.map_link(text).alias("m"))
    return rows.select("id", "whatsapp", "chat", "m.url", "m.object_id")


@query(f"""{L}, u AS (SELECT id, source, url, price FROM listings UNION ALL SELECT id + 1000000, upper(source) || ' ', url || ' ', price FROM listings UNION ALL SELECT -id, NULL, '', CASE WHEN id % 2 = 0 THEN price END FROM listings), k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(source)), trim(url) ORDER BY id) AS n FROM u WHERE price IS NOT NULL AND source IS NOT NULL)
  SELECT id, price FROM k WHERE n = 1 UNION ALL SELECT id, price FROM u WHERE source IS NULL AND price IS NOT NULL""")
def training_rows(spark, sf_dir):
    own = all_listings(spark, sf_dir).select("id", "source", "url", "price")
    again = own.select((F.col("id") + 1000000).alias("id"), F.concat(F.upper("source"), F.lit(" ")).alias("source"), F.concat("url", F.lit(" ")).alias("url"), "price")
    bare = own.select((-F.col("id")).alias("id"), F.lit(None).cast("string").alias("source"), F.lit("").alias("url"), F.when(F.col("id") % 2 == 0, F.col("price")).alias("price"))
    return labels.training_rows(own.unionByName(again).unionByName(bare), [F.col("id")]).select("id", "price")


@query(f"{L} SELECT org AS building_id, count(*) AS n, median(price) AS median_rent, round(median(price / area), 4) AS median_per_m2 FROM listings WHERE org <> 3 GROUP BY org")
def rent_by_building(spark, sf_dir):
    own = all_listings(spark, sf_dir).withColumn("building_id", F.nullif("org", F.lit(3)))
    return market.by_building(own).select("building_id", "n", "median_rent", F.round("median_per_m2", 4).alias("median_per_m2"))


# Models


def prepared(spark, sf_dir):
    rows = labels.quantile_label(all_listings(spark, sf_dir).withColumn("url", F.concat("url", F.format_string("/%d", "id"))))
    p = model.Preparation.fit(rows, ["rooms", "area", "floor", "total_floors", "quality_score"], ["source", "district"])
    return rows, p


@query(f"""{L}, v AS (SELECT title AS value, count(*) AS n FROM (SELECT lower(trim(title)) AS title FROM listings) GROUP BY title HAVING count(*) > 1) SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS at, n FROM v""")
def one_hot_places(spark, sf_dir):
    """The place of each title that two listings have in the one-hot part of a feature vector."""
    return model.Preparation.fit(all_listings(spark, sf_dir), [], ["title"]).categorical["title"][0]


@query()
def scored_listings(spark, sf_dir):
    """Verdicts of a boosted-tree model, trained on four folds of five and applied to all listings."""
    rows, p = prepared(spark, sf_dir)
    ready = p.transform(model.folds(rows, 5, ["url"])).select("id", "url", "price", "good", "fold", "features").cache()
    fitted = model.boosted(ready.filter("fold <> 0"))
    out = model.scored(fitted, ready)
    threshold = model.best_threshold(out.filter("fold = 0")).first()["t"]
    return out.select("id", "good", "fold", F.bround("prob", 3).alias("prob"), model.verdict(F.col("prob"), threshold).alias("verdict"))


@query(f"""{L}, c AS (SELECT id, CAST(price < 100000 AS INT) AS good FROM listings WHERE price IS NOT NULL), k(fold) AS (SELECT CAST(i AS INT) FROM range(5) g(i)) SELECT good, fold, (SELECT count(*) FROM c d WHERE d.good = s.good) // 5 + CASE WHEN fold < (SELECT count(*) FROM c d WHERE d.good = s.good) % 5 THEN 1 ELSE 0 END AS n
  FROM (SELECT DISTINCT good FROM c) s, k""")
def fold_sizes(spark, sf_dir):
    return stratified_folds(spark, sf_dir).filter("good IS NOT NULL").groupBy("good", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def stratified_folds(spark, sf_dir):
    rows = all_listings(spark, sf_dir).select("id", (F.col("price") < 100_000).cast("int").alias("good"))
    return model.folds(rows, 5, ["id"]).select("id", "good", "fold")


# Streams


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote."""
    path = fresh_path(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT day, user_id, count(*) AS n, count(*) > 5 AS over_quota FROM (SELECT CAST(ts AS DATE) AS day, user_id FROM events) WHERE day < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY day, user_id")
def stream_daily_quota(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.to_date(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 DAY")).alias("d"))
    return _drained(spark, streams.daily_quota(_events(spark, sf_dir), 5)).crossJoin(F.broadcast(last)).filter("day < d").drop("d")


@query("SELECT concat('u/', user_id) AS url, count(*) AS n FROM (SELECT user_id FROM events GROUP BY user_id) GROUP BY ALL")
def stream_first_pages(spark, sf_dir):
    own = _events(spark, sf_dir).select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("fetched_at"))
    return _drained(spark, streams.fresh_pages(own, "400 days")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT event_type AS source, concat('u/', user_id) AS url, CAST(floor(value) AS BIGINT) AS price, ts, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS was FROM events)
  SELECT source, url, count(*) FILTER (WHERE was IS NULL) AS n_new, count(*) FILTER (WHERE was <> price) AS n_changed FROM o GROUP BY ALL""")
def stream_price_changes(spark, sf_dir):
    own = _events(spark, sf_dir).select(F.col("event_type").alias("source"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"), F.floor("value").alias("price"), F.col("ts").alias("observed_at"))
    out = _drained(spark, streams.price_changes(own))
    return out.groupBy("source", "url").agg(F.count_if(F.col("kind") == "new").alias("n_new"), F.count_if(F.col("kind") == "changed").alias("n_changed"))

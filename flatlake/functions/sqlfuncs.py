"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import sites
from .texts import AGENT, KINDS, OWNER, WANTED



def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


#: name: (arguments, type, expression).
FUNCTIONS = {
    "fl_canonical_phone": ("raw STRING", "STRING", """
        CASE WHEN regexp_replace(raw, '[^0-9]', '') RLIKE '^(00)?[78][3-9][0-9]{9}$' THEN concat('+7', right(regexp_replace(raw, '[^0-9]', ''), 10))
             WHEN regexp_replace(raw, '[^0-9]', '') RLIKE '^[3-9][0-9]{9}$' THEN concat('+7', regexp_replace(raw, '[^0-9]', '')) ELSE '' END"""),
    "fl_listing_key": ("source STRING, url STRING, title STRING", "STRING", "substring(sha2(concat_ws('|', coalesce(source, ''), coalesce(url, ''), coalesce(title, '')), 256), 1, 16)"),
    "fl_freshness": ("published TIMESTAMP, as_of TIMESTAMP", "DOUBLE", """
        CASE WHEN published IS NULL THEN 0D WHEN timestampdiff(SECOND, published, as_of) <= 7200 THEN 1D WHEN timestampdiff(SECOND, published, as_of) <= 21600 THEN 0.95D
             WHEN timestampdiff(SECOND, published, as_of) <= 43200 THEN 0.9D WHEN timestampdiff(SECOND, published, as_of) <= 86400 THEN 0.8D
             WHEN timestampdiff(SECOND, published, as_of) <= 172800 THEN 0.6D WHEN timestampdiff(SECOND, published, as_of) <= 604800 THEN 0.3D ELSE 0.1D END"""),
    "fl_haversine": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 6371000 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"),
    "fl_listing_type": ("text STRING", "STRING", f"CASE WHEN left(lower(text), 80) RLIKE {_quoted(WANTED)} THEN 'WANTED' " + " ".join(f"WHEN lower(text) RLIKE {_quoted(p)} THEN '{k}'" for k, p in KINDS) + " ELSE 'UNKNOWN' END"),
    "fl_owner_probability": ("text STRING, has_org BOOLEAN", "DOUBLE", f"""
        bround(greatest(0D, least(1D, 0.5D - if(coalesce(has_org, false), 0.4D, 0D) + if(lower(coalesce(text, '')) RLIKE {_quoted(OWNER)}, 0.35D, 0D) - if(lower(coalesce(text, '')) RLIKE {_quoted(AGENT)}, 0.35D, 0D))), 2)"""),
    "fl_fingerprint": ("address STRING, rooms INT, area DOUBLE, floor INT, price BIGINT", "STRING", """
        CASE WHEN trim(coalesce(address, '')) = '' AND price IS NULL THEN '' ELSE concat_ws('|', coalesce(nullif(lower(trim(coalesce(address, ''))), ''), '_'), coalesce(string(rooms), '_'),
          coalesce(string(floor(area)), '_'), coalesce(string(floor), '_'), coalesce(string(CASE WHEN price <> 0 THEN price DIV 20000 * 20000 END), '_')) END"""),
    "fl_in_polygon": ("lat DOUBLE, lon DOUBLE, polygon ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>", "BOOLEAN", """
        lat IS NOT NULL AND lon IS NOT NULL AND size(polygon) > 2 AND size(filter(zip_with(polygon, concat(slice(polygon, 2, size(polygon)), slice(polygon, 1, 1)), (a, b) -> (a.lat > lat) <> (b.lat > lat)
          AND lon < (lat - a.lat) * ((b.lon - a.lon) / nullif(b.lat - a.lat, 0D)) + a.lon), x -> x)) % 2 = 1"""),
    "fl_price_band": ("price BIGINT", "BIGINT", "CASE WHEN price <> 0 THEN price DIV 20000 * 20000 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Scalar functions, and the table function page_cards(html, source)."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    sites.register(spark)
    return [*FUNCTIONS]

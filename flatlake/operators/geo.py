"""Districts, stations and dictionaries."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import fresh_path, join_counted, pinned

EARTH = 6_371_000.0
#: Bytes of the fragments of a dictionary that is handed to all tasks; its automaton takes some thirty times as much.
HELD_TEXT = 4_000_000
#: Bytes of texts whose pieces are shuffled at once, which takes some four times as much disk.
SLICED = 2_000_000_000
Polygon = tuple[str, list[tuple[float, float]]]


def haversine(lat1: Column, lon1: Column, lat2, lon2) -> Column:
    """Metres."""
    a1, o1, a2, o2 = (F.radians(F.lit(x) if not isinstance(x, Column) else x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2))
    return F.lit(2 * EARTH) * F.asin(F.sqrt(h))


def inside(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a polygon of (lat, lon); fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:  # a level edge is never crossed
            crossed = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + F.when(crossed, 1).otherwise(0)
    box = lat.between(min(p[0] for p in polygon), max(p[0] for p in polygon)) & lon.between(min(p[1] for p in polygon), max(p[1] for p in polygon))
    return box & (crossings % 2 == 1)


def district_of(lat: Column, lon: Column, districts: list[Polygon]) -> Column:
    """The first district, in table order, that a point is in. For tables of some hundred corners."""
    return F.coalesce(*(F.when(inside(lat, lon, polygon), F.lit(name)) for name, polygon in districts), F.lit(None).cast("string"))


def join_districts(points: DataFrame, polygons: DataFrame, cell: float = 0.02) -> DataFrame:
    """polygons: name, ord, polygon (array of (lat, lon)), of any number. Points and polygons' boxes are dealt to
    grid cells of `cell` degrees and joined by cell, so that no point is held against all polygons."""
    corners = polygons.filter(F.size("polygon") >= 3)
    ext = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
    span = lambda c: F.sequence(F.floor(ext(F.array_min, c) / cell), F.floor(ext(F.array_max, c) / cell))
    cells = corners.withColumn("cy", F.explode(span("lat"))).withColumn("cx", F.explode(span("lon")))
    edges = F.zip_with("polygon", F.concat(F.slice("polygon", 2, F.size("polygon") - 1), F.slice("polygon", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.struct("ord", "name", edges.alias("edges"))
    by_cell = cells.groupBy("cy", "cx").agg(F.array_sort(F.collect_list(found)).alias("__held"))  # the few polygons of a cell, by ord
    own = points.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    met = own.join(by_cell, ["cy", "cx"], "left")
    crossings = lambda edges: F.size(F.filter(edges, lambda e: ((e["a"]["lat"] > F.col("lat")) != (e["b"]["lat"] > F.col("lat"))) & (F.col("lon") < (e["b"]["lon"] - e["a"]["lon"]) * (F.col("lat") - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])))
    first = F.get(F.filter("__held", lambda h: crossings(h["edges"]) % 2 == 1), F.lit(0))
    return met.withColumn("district_name", first["name"]).drop("cy", "cx", "__held")


def nearest_station(lat: Column, lon: Column, stations: list[tuple[str, float, float]]) -> Column:
    """Struct (dist, station), the nearest of a few; ties by name."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(F.array(*(F.struct(haversine(lat, lon, y, x).alias("dist"), F.lit(name).alias("station")) for name, y, x in stations))))


def join_buildings(listings: DataFrame, buildings: DataFrame, fields: list[str], key: str = "building_id") -> DataFrame:
    """Fills fields that are null or empty from the building of the same id."""
    b = buildings.select(key, *(F.col(c).alias(f"__b_{c}") for c in fields))
    joined = listings.join(b, key, "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return joined.withColumns({c: F.when(empty(c), F.coalesce(f"__b_{c}", c)).otherwise(F.col(c)) for c in fields}).drop(*(f"__b_{c}" for c in fields))


def lookup_names(df: DataFrame, text: Column, index: DataFrame, name: str = "name", held: int = HELD_TEXT) -> DataFrame:
    """index: fragment, name, position. Each row with the name of the first fragment, by position, that its text contains,
    whatever the case, or null; of fragments at one position, the first as a text. Empty and null fragments name nothing,
    nor do those without a position. An index of up to `held` bytes of fragments becomes an automaton that all tasks get; a
    text is then read once, however many fragments there are. Of a larger one the automaton has how fragments begin, and
    texts are joined to it by the pieces that may be a fragment as a whole."""
    fragments = index.select(F.lower("fragment").alias("__f"), F.col("name").alias("__name"), F.col("position").alias("__p")).filter("__f <> '' AND __p IS NOT NULL")
    first = fragments.groupBy("__f").agg(F.min(F.struct("__p", "__name")).alias("__s")).select("__f", "__s.*")
    size = first.agg(F.sum(F.octet_length("__f"))).first()[0] or 0
    if size <= held:
        return df.withColumn(name, _named(first)(F.lower(text)))
    return _joined_names(df, text, first, name, held)


def _automaton(words: list[str]):
    """An automaton (Aho-Corasick) that gives the places in `words` of those that a text contains."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, word in enumerate(words):
        found.add_word(word, k)
    if words:
        found.make_automaton()
    return found if words else None


def _named(fragments: DataFrame):
    """An Arrow UDF that finds the name of a text's first fragment by an automaton over all of them."""
    rows = fragments.orderBy("__p", "__f").collect()  # of bounded size
    shared = fragments.sparkSession.sparkContext.broadcast((_automaton([r["__f"] for r in rows]), [r["__name"] for r in rows]))

    @F.pandas_udf("string")
    def name_of(texts: pd.Series) -> pd.Series:
        automaton, names = shared.value
        first = [min((k for _, k in automaton.iter(t)), default=None) if automaton and t else None for t in texts]
        return pd.Series([None if k is None else names[k] for k in first], dtype=object)

    return name_of


#: Lengths, in characters, of the beginnings of fragments that may be told apart.
BEGINNINGS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 24, 32, 48, 64)


def _heads(fragments: DataFrame, held: int) -> DataFrame:
    """(head, ends): how fragments begin, by the longest beginnings that with their ends take `held` bytes or so, and the
    lengths and last characters of the fragments that begin so. At least one character is held of each beginning."""
    ends = F.struct(F.length("__f").alias("length"), F.right("__f", F.lit(1)).alias("last"))
    of = lambda n: F.struct(F.left("__f", F.lit(n)), ends)
    seen = fragments.agg(*(F.approx_count_distinct(of(n)).alias(f"n{n}") for n in BEGINNINGS), *(F.max(F.octet_length(F.left("__f", F.lit(n)))).alias(f"b{n}") for n in BEGINNINGS)).first()
    fit = [n for n in BEGINNINGS if seen[f"n{n}"] * (seen[f"b{n}"] + 8) <= held]
    head = F.left("__f", F.lit(max(fit, default=1)))
    return fragments.groupBy(head.alias("head")).agg(F.collect_set(ends).alias("ends"))


def _pieces(fragments: DataFrame, held: int):
    """An Arrow UDF that gives the pieces of a text that may be fragments: they begin and end like one of that length."""
    rows = _heads(fragments, held).collect()
    words = [r["head"] for r in rows]
    shared = fragments.sparkSession.sparkContext.broadcast((_automaton(words), [(len(r["head"]), [tuple(e) for e in r["ends"]]) for r in rows]))

    @F.pandas_udf("array<string>")
    def pieces_of(texts: pd.Series) -> pd.Series:
        automaton, ends = shared.value
        out = []
        for t in texts:
            found = set()
            for at, k in automaton.iter(t) if automaton and t else ():
                own, known = ends[k]
                start = at + 1 - own
                found.update(t[start : start + n] for n, last in known if t[start + n - 1 : start + n] == last)
            out.append(list(found))
        return pd.Series(out, dtype=object)

    return pieces_of


def _joined_names(df: DataFrame, text: Column, fragments: DataFrame, name: str, held: int) -> DataFrame:
    """Pieces are joined to equal fragments, and the texts to what was found for them by 128 bits of their SHA-256. A text that
    very many rows have is handed to all tasks. Texts are dealt to slices by these bits, and the pieces of a slice are off the disks before
    those of the next are made; what is found, a row for each text, stays."""
    low, path = F.lower(text), fresh_path(df.sparkSession, "fragments")
    key = F.substring(F.unhex(F.sha2(low, 256)), 1, 16)
    hashed = F.xxhash64("__f").alias("__h")  # sorts faster than texts that begin alike
    fragments.select("*", hashed).write.parquet(path)
    fragments = df.sparkSession.read.parquet(path)
    pieces_of, found = _pieces(fragments, held), []
    slices = math.ceil((df.agg(F.sum(F.octet_length(low))).first()[0] or 1) / SLICED)
    for k in range(slices):
        own = df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == k) if slices > 1 else df
        pieces = own.select(key.alias("__key"), F.explode(pieces_of(low)).alias("__f")).select("*", hashed)
        first = pieces.join(fragments, ["__h", "__f"]).groupBy("__key").agg(F.min_by("__name", F.struct("__p", "__f")).alias(name), F.count(F.lit(1)).alias("__n"))
        found.append(pinned(first))
    return join_counted(df.withColumn("__key", key), reduce(DataFrame.unionByName, found), "__key", "__n", F.xxhash64(*df.columns)).drop("__key", "__n")

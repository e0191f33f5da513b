"""Phone numbers: one canonical form, and where a page keeps its contact number."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import blank_to_null, found

#: A run of digits with the separators that people write.
CANDIDATE = r"(?<![0-9])(\+?[0-9][0-9()\- ]{8,16}[0-9])(?![0-9])"
WHATSAPP = r"(?i)(?:wa\.me/?|whatsapp(?:://|\.com/)send/?\?phone=)\+?([0-9]{10,15})"
#: Words next to which a number is a phone.
WORDS = "(?:phone|tel|contact|whatsapp|viber|телефон|звон|контакт|связь|мобил)"


def canonical_digits(digits: Column) -> Column:
    """+7 and ten digits, from 10 digits, or 11 that start with 7 or 8, with or without 00; else null."""
    own = F.when(digits.startswith("00"), F.substring(digits, 3, 99)).otherwise(digits)
    ten = F.when((F.length(own) == 11) & own.rlike("^[78]"), F.substring(own, 2, 10)).otherwise(own)
    return F.when(ten.rlike("^[3-9][0-9]{9}$"), F.concat(F.lit("+7"), ten))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_phone(x: Column) -> Column:
    """Empty if it is no phone; a WhatsApp link's number comes first."""
    return F.coalesce(canonical_digits(_said(x)), F.lit(""))


def _said(x: Column) -> Column:
    return F.coalesce(found(x, WHATSAPP), digits_of(x))


def valid_phone(x: Column) -> Column:
    """Null for masked numbers."""
    return F.when(~x.rlike(r"[*?•.]"), canonical_digits(digits_of(x)))


def phones_in(text: Column) -> Column:
    """Array of the valid phones of a text in order; ten bare digits are ids, not phones."""
    spans = F.filter(F.regexp_extract_all(text, F.lit(CANDIDATE), 1), lambda c: ~c.rlike("^[0-9]{10}$"))
    return F.array_compact(F.transform(spans, valid_phone))


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def _decoded(html: Column) -> Column:
    """Texts hidden in scripts as base64 or character codes."""
    base64 = F.transform(_all(html, r"[\"']([A-Za-z0-9+/]{16,}={0,2})[\"']"), lambda b: F.try_to_binary(b, F.lit("base64")).cast("string"))
    codes = F.transform(
        _all(html, r"fromCharCode\(([0-9,\s]{4,300})\)"),
        lambda c: F.array_join(F.transform(F.filter(F.split(c, r"\s*,\s*"), lambda n: n.rlike("^[0-9]{1,3}$")), lambda n: F.char(n.cast("long"))), ""),
    )
    return F.array_compact(F.concat(base64, codes))


def contact_phone(html: Column, blacklist: list[str] | None = None) -> Column:
    """Struct (phone, stage): stages are tried in order, and the first number that is valid and not barred wins."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    scripts = F.array_join(_all(html, r"(?is)<script\b[^>]*>(.*?)</script>"), " ")
    loose = r"([+0-9][0-9\s\-().]{8,18}[0-9])"
    stages = {
        "button": F.flatten(F.transform(_all(html, r"(?iU)<(?:button|a|span|div|p)\b([^>]*>[^<]*показать\s+(?:телефон|номер)[^<]*)<"), phones_in)),
        "tel_link": F.transform(_all(html, r"(?i)href=[\"']tel:([^\"']+)[\"']"), valid_phone),
        "wa_link": F.transform(_all(html, WHATSAPP), valid_phone),
        "data_attr": F.transform(_all(html, r"(?i)\bdata-(?:phone|tel|phonenumber|phone-number)=[\"']([^\"']+)[\"']"), valid_phone),
        "json_state": F.transform(_all(html, r"(?i)[\"'](?:phones?|phone_?number|telephone|mobile|contact_?phone)[\"']\s*:\s*\[?\s*[\"']?([+0-9][0-9\s\-()]{8,18}[0-9])"), valid_phone),
        "js_script": F.concat(F.transform(_all(scripts, rf"(?iU){WORDS}\w*\s*[:=]\s*[\"']{loose}"), valid_phone), F.flatten(F.transform(_decoded(scripts), phones_in))),
        "visible_text": phones_in(text),
        "raw_keyword": F.transform(_all(html, rf"(?iU)\b{WORDS}[^<>{{}}]{{0,50}}?{loose}"), valid_phone),
        "multi_algo": F.transform(_all(html, r"(?i)(?:tel|sms):([+0-9][0-9\s\-()]{6,18}[0-9])"), valid_phone),
    }
    barred = F.array(*(F.lit(p) for p in blacklist or [])).cast("array<string>")
    first = lambda phones: F.get(F.filter(phones, lambda p: p.isNotNull() & ~F.array_contains(barred, p)), F.lit(0))
    best = F.coalesce(*(F.when(first(p).isNotNull(), F.struct(first(p).alias("phone"), F.lit(name).alias("stage"))) for name, p in stages.items()))
    return F.coalesce(best, F.struct(F.lit("").alias("phone"), F.lit("").alias("stage")))


#: Parts of keys under which contact numbers stand.
PHONE_KEYS = ("phone", "tel", "contact", "seller")


def _scalars(node: object, reach: int = 0) -> Iterator[tuple[bool, str]]:
    """Texts and whole numbers of a JSON value in order, and whether each is close under a phone-like key: its value, a
    member of it, or a member of an object in its list."""
    if isinstance(node, dict):
        for key, value in node.items():
            named = any(k in str(key).lower() for k in PHONE_KEYS)
            yield from _scalars(value, 3 if named else reach - 1 if not isinstance(value, dict | list) else 0)
    elif isinstance(node, list):
        for value in node:
            yield from _scalars(value, reach - 1)
    elif isinstance(node, str | int) and not isinstance(node, bool):
        yield reach > 0, str(node)


def _json_phones(record: str | None) -> list[str]:
    try:
        found = list(_scalars(json.loads(record or "")))
    except (ValueError, RecursionError):
        found = [(True, x) for x in re.findall(r'"(?:phones?|tel|telephone|mobile)"\s*:\s*\[?\s*"([^"]{6,20})"', record or "")]
    digits = [(near, re.sub("[^0-9]", "", x)) for near, x in found]
    good = [(near, d) for near, d in digits if re.fullmatch("[78][0-9]{9,10}", d)]
    return list(dict.fromkeys([d for near, d in good if near] or [d for _, d in good]))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def phones_in_json(record):
    """Distinct 10 or 11 digit numbers that start with 7 or 8 of a JSON text: those under phone-like keys, else all. JSON has
    escapes and nesting that patterns don't see, so this is an Arrow UDF; broken JSON is searched by patterns."""
    return _json_phones(record)


def without_barred(df: DataFrame, blacklist: DataFrame, phone: str = "phone") -> DataFrame:
    """df with the phones that the blacklist (phone) holds emptied; the list is of any length, compared in canonical form."""
    # Columns of their own, so that the patterns are tried once a row, and one join of all rows. Those without a number are spread.
    numbered = lambda rows, c: rows.withColumn("__said", _said(F.col(c))).withColumn("__p", F.coalesce(canonical_digits(F.col("__said")), F.lit("")))
    barred = numbered(blacklist, "phone").select("__p").filter("__p <> ''").distinct().withColumn("__barred", F.lit(True))
    own = numbered(df, phone)
    none = F.concat(F.lit("-"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)), F.lit(4096)).cast("string"))
    own = own.withColumn("__p", F.when(F.col("__p") == "", none).otherwise(F.col("__p")))
    return own.join(barred, "__p", "left").withColumn(phone, F.when(F.col("__barred"), F.lit("")).otherwise(F.col(phone))).select(*df.columns)


def whatsapp(text: Column) -> Column:
    return F.coalesce(canonical_digits(found(text, WHATSAPP)), F.lit(""))


def chat_handle(text: Column) -> Column:
    return F.coalesce(found(text, r"(?<![A-Za-z0-9_])@([A-Za-z0-9_]{5,32})\b"), found(text, r"(?i)\bt\.me/([A-Za-z0-9_]{5,32})\b"), F.lit(""))


def map_link(text: Column, city: str = "almaty") -> Column:
    """Struct (url, lat, lon, object_id) of a map link; city is a pattern."""
    url = found(text, rf"(?i)(https?://2gis\.kz/(?:{city})/(?:geo|firm|branches)/[^\s\"')]+)")
    number = lambda g: found(url, r"[?&]m=([0-9.]+),([0-9.]+)", g).try_cast("double")
    return F.struct(url.alias("url"), number(1).alias("lat"), number(2).alias("lon"), blank_to_null(F.regexp_extract(url, "/(?:firm|branches)/([0-9]+)", 1)).alias("object_id"))

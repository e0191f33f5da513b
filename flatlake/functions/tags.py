"""Tags and grades of listing texts, from rules that are data.

A tag is set if the lower-cased text holds one of its phrases or matches its pattern. Phrases are tested by
containment, which is much faster; patterns are for the rules that need word rests, optional blanks or word ends, and are
only tried on texts that hold the plain part of one of their alternatives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import found

#: The tags in their order, and the phrases, in Russian, Kazakh and English, that set each.
TAGS: dict[str, list[str]] = {
    "new_building": ["новостройк", "новый дом", "жаңа тұрғын үй", "new building"],
    "secondary": ["вторичк", "старый фонд"],
    "studio": ["студи", "баш көтерілім"],
    "apartments": ["апартамент", "апарт-", "penthouse", "пентхаус"],
    "euro_layout": ["евроформат"],
    "balcony": ["балкон"],
    "loggia": ["лоджи"],
    "two_bathrooms": ["ванная и гостев"],
    "separated_bathroom": ["санузел раздельн", "раздельный санузел"],
    "combined_bathroom": ["санузел совмещ"],
    "shower": [],
    "bath": [],
    "washer": ["washing"],
    "fridge": ["холодильник", "мұздатқыш"],
    "ac": ["кондиционер"],
    "dishwasher": ["посудомойк"],
    "tv": ["телевизор"],
    "oven": ["духовк", "печь"],
    "microwave": ["микроволнов", "свч", "мікрохвильов"],
    "internet": [],
    "wifi": ["wifi", "wi-fi", "вайфай", "вай-фай"],
    "smart_lock": ["кодовый замок"],
    "counters": ["счетчик", "счётчик"],
    "autonomous_heating": [],
    "central_heating": [],
    "water_included": ["вода включена", "коммунальные включены", "ку включены"],
    "boiler": ["бойлер", "водонагреват"],
    "parking": ["парковк", "парковочное место", " parking", "тұрақ"],
    "garage": ["гараж"],
    "security": ["кпп", "пропускной режим", "қорғау"],
    "concierge": ["консьерж"],
    "cctv": ["видеонаблюден", "cctv"],
    "closed_yard": [],
    "playground": ["детская площадка", "балабақша алаңы"],
    "elevator": [],
    "freight_elevator": ["грузовой лифт"],
    "gym": ["спортзал", "fitness", "фитнес"],
    "view_mountains": ["вид на горы", "горный вид", "тау көрінісі"],
    "view_park": ["вид на парк", "вид на дерев", "парковый вид"],
    "panoramic": ["панорама"],
    "corner": [],
    "near_metro": ["рядом с метро", "возле метро", "около метро"],
    "near_school": ["рядом школа", "рядом со школой", "около школы", "школа в пешей"],
    "near_kindergarten": ["рядом детский сад", "рядом садик", "около детского сада", "около садика"],
    "near_park": ["рядом парк", "рядом сквер", "около парка", "около сквера"],
    "near_shop": ["рядом магазин", "рядом рынок", "рядом торговый центр", "рядом магnum", "рядом tspan", "в шаговой доступности ", "в шаговой , "],
    "urgent": ["срочно", "сдаётся сегодня", "сдается сегодня", "заезжай сегодня", "тез"],
    "bargain": ["возможен торг", "уместен торг", "скидк"],
    "no_commission": ["без комиссии", "комиссия 0", "без агентских", "0% комиссия"],
    "no_agency": ["без посредников", "без агентств"],
    "owner": ["хозяин", "от собственника", "собственник сдает", "иесі"],
    "long_term": ["на длительный срок", "долгосрочная аренда", "долгосрочно"],
    "daily": ["посуточно", "на сутки", "daily"],
    "for_family": ["для семьи", "семейным", "для семейных"],
    "for_students": ["для студентов", "студентам"],
    "appliances_included": ["со всей техникой"],
    "quiet_yard": [],
    "prestige": ["бизнес-класс", "бизнес класс", "premium", "премиум"],
}
#: The patterns that set a tag.
PATTERNS: dict[str, str] = {
    "new_building": r"нов\w+ жк|сдан\w* в эксплуат|нов\w+ комплекс",
    "secondary": r"вторичн\w+ рынок",
    "studio": r"studios?\b",
    "euro_layout": r"евро\s*планировк|евро\s*ремонт планировк",
    "two_bathrooms": r"два? санузл|2\s*санузл|два? с/у|2\s*с/у",
    "separated_bathroom": r"раздельн\w+ сануз|раздельн\w+ с/у",
    "combined_bathroom": r"совмещ\w+ сануз|совмещенн\w+ с/у",
    "shower": r"душев\w+ кабин|душ\b",
    "bath": r"ванн\w+\b",
    "washer": r"стиральн\w+ машин|ст\.?\s*машин",
    "ac": r"сплит\s*систем|климат\s*контроль",
    "dishwasher": r"посудомоечн\w+ машин",
    "tv": r"\bтв\b|smart\s*tv|\btv\b",
    "oven": r"плита\s*(?:газ|электро)",
    "internet": r"интернет\b",
    "smart_lock": r"умн\w+ замок|smart\s*lock",
    "autonomous_heating": r"автономн\w+ отоплен|индивидуальн\w+ отоплен",
    "central_heating": r"центральн\w+ отоплен",
    "security": r"охран\w+",
    "closed_yard": r"закрыт\w+ двор|закрыт\w+ территор|огорожен\w+ территор",
    "playground": r"детск\w+ площадк",
    "elevator": r"лифт\b",
    "freight_elevator": r"грузов\w+ лифт",
    "gym": r"тренажерн\w+ зал",
    "panoramic": r"панорамн\w+ (?:окн|вид)",
    "corner": r"углов\w+ (?:квартир|дом)|угловая\b",
    "near_metro": r"метро\s+[«\"\w]|метро\b",
    "bargain": r"торг\b",
    "appliances_included": r"техника\s+(?:есть|включена)",
    "quiet_yard": r"тих\w+ двор|зелен\w+ двор|ухоженн\w+ двор",
    "prestige": r"элитн\w+|престижн\w+",
}
#: Ordered grades, with their phrases and patterns; the first that holds decides.
RENOVATION = [
    (3, ["евроремонт", "жаңа ремонт", "еуро ремонт"], r"дизайнерск\w+ ремонт|нов\w+ ремонт|свеж\w+ ремонт|ремонт\s+со\s+вкусом|капитальн\w+ ремонт"),
    (2, ["сделан ремонт", "есть ремонт", "хороший ремонт"], r"ремонт 20\d\d"),
    (0, ["требует ремонта", "нужен ремонт", "без ремонта", "под ремонт", "ремонт сделат", "ремонт жоқ"], r"косметическ\w+ ремонт|чернов\w+ (?:отделк|ремонт)"),
]
FURNITURE = [
    ("full", ["полностью меблирован", "вся мебель", "полностью furnished", "толық жиһаз"], r"полност\w+ укомплектован|мебель\w*\s+и\s+техника\s+есть"),
    ("partial", ["частично меблирован", "частично есть мебель", "некоторая мебель", "минимум мебели", "жиһаз ішінара"], None),
    ("none", ["без мебели", "мебели нет", "жиһазсыз"], None),
]
BUILDING = [
    ("панель", ["панел"], None),
    ("кирпич", ["киір"], r"кирпичн\w+ дом|\bкирпич\b"),
    ("монолит", ["монолит"], None),
    ("каркас", ["каркас"], None),
    ("блок", [], r"блочн\w+ дом"),
]
BATHROOM = {"separated": "separated_bathroom", "combined": "combined_bathroom", "shower": "shower", "bath": "bath"}
#: The tag columns in their order; the last five follow from the grades.
NAMES = [f"tag_{t}" for t in [*TAGS, "euro_renovation", "needs_repair", "fully_furnished", "partial_furnished", "unfurnished"]]
FURNITURE_LEVEL = {"none": 0, "partial": 1, "full": 2}


def stems(pattern: str) -> list[str]:
    """For each alternative of a pattern, its longest stretch of plain characters, which every match has to hold. A character
    that may be left out isn't part of one; what stands in brackets isn't looked at."""
    out, runs, run, depth, k = [], [], "", 0, 0
    while k <= len(pattern):
        c = pattern[k : k + 1]
        if c and not depth and (c.isalnum() or c in " /-"):
            run += c
        elif c and c in "?*{" and run:
            runs, run = [*runs, run[:-1]], ""
        else:
            runs, run = [*runs, run], ""
        if not depth and c in ("|", ""):
            out, runs = [*out, max(runs, key=len)], []
        depth += (c in ("(", "[")) - (c in (")", "]"))
        k += 2 if c == "\\" else 1
    return out


def contains_any(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def matches(low: Column, pattern: str) -> Column:
    """Whether a pattern matches, asked only of texts that hold a stem of it."""
    known = stems(pattern)
    return contains_any(low, known) & low.rlike("(?U)" + pattern) if all(known) else low.rlike("(?U)" + pattern)


def holds(low: Column, phrases: list[str], pattern: str | None) -> Column:
    """Whether a lower-cased text holds one of the phrases or matches the pattern."""
    tests = ([contains_any(low, phrases)] if phrases else []) + ([matches(low, pattern)] if pattern else [])
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def graded(low: Column, rules: list) -> Column:
    return F.coalesce(*(F.when(holds(low, phrases, pattern), F.lit(value)) for value, phrases, pattern in rules))


def year_built(low: Column) -> Column:
    after = found(low, r"(?U)(?:дом|построен\w*|постройки|сдан\w*|год)\s*[:,]?\s*((?:19|20)[0-9]{2})")
    before = found(low, r"((?:19|20)[0-9]{2})\s*года?\s*(?:постройки|сдачи)")
    return F.when(contains_any(low, ["дом", "постро", "сдан", "год"]), F.coalesce(after, before)).try_cast("int")


def ceiling_height(low: Column) -> Column:
    height = found(low, r"(?U)потолк\w*\s*(?:—|–|-|:)?\s*([0-9](?:[.,][0-9])?)\s*(?:м\b|метр)")
    return F.when(low.contains("потолк"), F.replace(height, F.lit(","), F.lit("."))).try_cast("double")


def with_tags(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """df with all tag columns (0 or 1), the grades, and what numbers the text gives. The lower-cased text and the
    grades are computed once, in projections of their own, as many columns use them."""
    text = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit(""))))
    low = F.col("__low")
    own = df.withColumn("__low", text)
    own = own.withColumns({"renovation_grade": graded(low, RENOVATION), "furniture_level": graded(low, FURNITURE), "building_type": graded(low, BUILDING), "year_built": year_built(low), "ceiling_height": ceiling_height(low)})
    own = own.withColumns({f"tag_{name}": holds(low, phrases, PATTERNS.get(name)).cast("int") for name, phrases in TAGS.items()})
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
    of_grades = {"tag_euro_renovation": same("renovation_grade", 3), "tag_needs_repair": same("renovation_grade", 0), "tag_fully_furnished": same("furniture_level", "full"), "tag_partial_furnished": same("furniture_level", "partial"), "tag_unfurnished": same("furniture_level", "none")}
    kind = F.coalesce(*(F.when(F.col(f"tag_{tag}") == 1, F.lit(name)) for name, tag in BATHROOM.items()))
    return own.withColumns(of_grades | {"bathroom_type": kind}).drop("__low")


def tag_list(tags: list[str]) -> Column:
    """Names of the tag columns that are 1, joined by "|"."""
    return F.concat_ws("|", *(F.when(F.col(t) == 1, F.lit(t.removeprefix("tag_"))) for t in tags))

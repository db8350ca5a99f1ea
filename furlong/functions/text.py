"""Names and texts of racing data, as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Venue tokens of exchange events, courses with their other spellings, words in course
# names that are no part of the name, countries after a horse's name.
VENUE_TOKENS = {
    "leop": "Leopardstown", "curr": "Curragh", "gowr": "Gowran Park", "gowp": "Gowran Park", "navan": "Navan", "punc": "Punchestown", "punch": "Punchestown",
    "fair": "Fairyhouse", "tipp": "Tipperary", "cork": "Cork", "kill": "Killarney", "down": "Down Royal", "naas": "Naas", "limk": "Limerick", "galw": "Galway",
    "sligo": "Sligo", "tramore": "Tramore", "chelt": "Cheltenham", "ascot": "Ascot", "good": "Goodwood", "newm": "Newmarket", "donc": "Doncaster",
    "hayd": "Haydock", "newb": "Newbury", "sand": "Sandown", "wind": "Windsor", "leic": "Leicester", "nott": "Nottingham", "wolv": "Wolverhampton",
    "kemp": "Kempton", "chms": "Chelmsford", "ling": "Lingfield", "redc": "Redcar", "ayr": "Ayr", "carl": "Carlisle", "muss": "Musselburgh", "ches": "Chester",
    "bev": "Beverley", "ripo": "Ripon", "thir": "Thirsk", "pont": "Pontefract", "catt": "Catterick", "brig": "Brighton", "epso": "Epsom", "bath": "Bath",
    "sali": "Salisbury", "yarm": "Yarmouth", "nwcs": "Newcastle", "newc": "Newcastle", "sthl": "Southwell", "chep": "Chepstow", "wrcr": "Worcester",
    "worc": "Worcester", "ludl": "Ludlow", "uttx": "Uttoxeter", "warw": "Warwick", "stfd": "Stratford", "plum": "Plumpton", "font": "Fontwell",
    "wins": "Wincanton", "towc": "Towcester", "hexm": "Hexham", "kelso": "Kelso", "perth": "Perth", "bang": "Bangor", "cart": "Cartmel", "here": "Hereford",
    "mark": "Market Rasen", "mket": "Market Rasen", "hunt": "Huntingdon", "exet": "Exeter", "taun": "Taunton", "nwtn": "Newton Abbot", "nton": "Newton Abbot",
}
COURSES = [
    "Aintree", "Ascot", "Ayr", "Ballinrobe", "Bangor-on-Dee", "Bath", "Bellewstown", "Beverley", "Brighton", "Carlisle", "Cartmel", "Catterick", "Chelmsford",
    "Cheltenham", "Chepstow", "Chester", "Clonmel", "Cork", "Curragh", "Doncaster", "Down Royal", "Downpatrick", "Dundalk", "Epsom", "Exeter", "Fairyhouse",
    "Fakenham", "Ffos Las", "Fontwell", "Galway", "Goodwood", "Gowran Park", "Hamilton", "Haydock", "Hexham", "Huntingdon", "Kelso", "Kempton", "Kilbeggan",
    "Killarney", "Laytown", "Leicester", "Leopardstown", "Limerick", "Lingfield", "Listowel", "Ludlow", "Market Rasen", "Musselburgh", "Naas", "Navan",
    "Newbury", "Newcastle", "Newmarket", "Newton Abbot", "Nottingham", "Perth", "Plumpton", "Pontefract", "Punchestown", "Redcar", "Ripon", "Roscommon",
    "Salisbury", "Sandown", "Sedgefield", "Sligo", "Southwell", "Stratford", "Taunton", "Thirsk", "Thurles", "Tipperary", "Towcester", "Tramore", "Uttoxeter",
    "Warwick", "Wetherby", "Wexford", "Wincanton", "Windsor", "Wolverhampton", "Worcester", "Yarmouth", "York",
]
SPELLINGS = {
    "aint": "Aintree", "ballin": "Ballinrobe", "bang": "Bangor", "belle": "Bellewstown", "bev": "Beverley", "brig": "Brighton", "carl": "Carlisle",
    "cart": "Cartmel", "catt": "Catterick", "chelmc": "Chelmsford", "chelt": "Cheltenham", "chep": "Chepstow", "ches": "Chester", "chest": "Chester",
    "chms": "Chelmsford", "clon": "Clonmel", "curr": "Curragh", "donc": "Doncaster", "downp": "Downpatrick", "downr": "Down Royal", "dund": "Dundalk",
    "epso": "Epsom", "epsm": "Epsom", "extr": "Exeter", "fairy": "Fairyhouse", "fake": "Fakenham", "ffos": "Ffos Las", "ffosl": "Ffos Las",
    "folk": "Folkestone", "font": "Fontwell", "gal": "Galway", "good": "Goodwood", "gowp": "Gowran Park", "ham": "Hamilton", "hayd": "Haydock",
    "here": "Hereford", "hex": "Hexham", "hexm": "Hexham", "hunt": "Huntingdon", "kemp": "Kempton", "kilb": "Kilbeggan", "killar": "Killarney",
    "layt": "Laytown", "leic": "Leicester", "leop": "Leopardstown", "lim": "Limerick", "ling": "Lingfield", "lngf": "Lingfield", "list": "Listowel",
    "ludl": "Ludlow", "mrktr": "Market Rasen", "muss": "Musselburgh", "newb": "Newbury", "newc": "Newcastle", "newm": "Newmarket", "newt": "Newton Abbot",
    "nmkt": "Newmarket", "nott": "Nottingham", "plum": "Plumpton", "plump": "Plumpton", "pont": "Pontefract", "ponte": "Pontefract", "punch": "Punchestown",
    "redc": "Redcar", "ripo": "Ripon", "rosc": "Roscommon", "sali": "Salisbury", "salis": "Salisbury", "sand": "Sandown", "sedge": "Sedgefield",
    "sthl": "Southwell", "strat": "Stratford", "taun": "Taunton", "thir": "Thirsk", "thurl": "Thurles", "tipp": "Tipperary", "towe": "Towcester",
    "towc": "Towcester", "tram": "Tramore", "uttx": "Uttoxeter", "uttox": "Uttoxeter", "warw": "Warwick", "weth": "Wetherby", "wex": "Wexford",
    "winc": "Wincanton", "wins": "Wincanton", "wind": "Windsor", "wolv": "Wolverhampton", "worc": "Worcester", "yarm": "Yarmouth",
}
SURFACE_WORDS = ["tapeta", "polytrack"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
HORSE_COUNTRIES = ["IRE", "GB", "FR", "USA", "AUS", "GER", "ITY"]
EVENT = r"^(?:gb|ire|ie|fr)\s*/\s*([a-z]+)"

#: Every spelling of a course, in lower case, and its name.
COURSE_ALIASES = {c.lower(): c for c in COURSES} | SPELLINGS
#: Patterns that are taken out of a lower-case course name, in this order.
NOT_OF_A_COURSE = [
    "|".join(SURFACE_WORDS),
    r"\([^)]*\)",
    r"^(gb|ire|ie)\s*/\s*",
    r"\b\d{1,2}(st|nd|rd|th)?\b",
    rf"\b({'|'.join(MONTHS)})\b",
]
# Words in a market's name by kind of race, in order; words in the names of Irish courses.
RACE_KINDS = {
    "Chase": ["chase", "steeple", "steeplechase", "chs"],
    "Hurdle": ["hurdle", "hdle", "hrd"],
    "NH Flat": ["nh flat", "nhf", "inhf", "bumper", "national hunt flat"],
}
IRISH_COURSES = [
    "cork", "navan", "leopardstown", "curragh", "galway", "fairyhouse", "punchestown", "dundalk", "limerick", "tipperary", "killarney", "listowel", "gowran", "wexford",
    "sligo", "clonmel", "thurles", "downpatrick", "down royal", "kilbeggan", "ballinrobe", "roscommon", "naas", "tramore", "laytown", "bellewstown",
]
#: And out of a horse's: a lone or trailing I before a bracket, brackets, a country at the end.
NOT_OF_A_HORSE = [r"(?<=[A-Za-z])I(?=\s*\()", r"\bI\b(?=\s*\()", r"\([^)]*\)", rf"(?i)\b(?:{'|'.join(HORSE_COUNTRIES)})\b$"]


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slugify(x: str | Column) -> Column:
    """Lower-case words joined by ``_``; null if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(_col(x))), r"[^a-z0-9\s_-]", "")
    joined = F.regexp_replace(kept, r"[\s-]+", "_")
    return F.nullif(F.regexp_replace(joined, r"^_+|_+$", ""), F.lit(""))


def compact(x: str | Column) -> Column:
    """Only the letters a-z and digits of a lower-cased text."""
    return F.regexp_replace(F.lower(_col(x)), r"[^a-z0-9]", "")


def without(x: Column, patterns: list[str]) -> Column:
    """A text without the patterns, one after the other."""
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[key]


def normalise_horse(x: str | Column) -> Column:
    """A horse's name as a slug: without bracketed parts, a country at its end, or an I before a bracket; empty if nothing is left."""
    return F.when(_col(x).isNotNull(), F.coalesce(slugify(without(F.trim(_col(x)), NOT_OF_A_HORSE)), F.lit("")))


def normalise_course(x: str | Column) -> Column:
    """A course's name: of an exchange event (``GB / Newm 3rd Apr``) by its venue token, of others by spelling.

    Surfaces, brackets, days and months don't count. A name that has no known spelling is told by its
    first word, or else is its own lower-case text.
    """
    token, plain, first = course_keys(x)
    event = F.coalesce(lookup(VENUE_TOKENS, token), lookup(COURSE_ALIASES, token), token)
    return F.coalesce(event, lookup(COURSE_ALIASES, plain), lookup(COURSE_ALIASES, first), plain)


def course_keys(x: str | Column) -> tuple[Column, Column, Column]:
    """What a course's text is looked up by: the venue token of an exchange event, the plain name, its first word."""
    raw = F.trim(_col(x))
    token = F.nullif(F.regexp_extract(F.lower(raw), EVENT, 1), F.lit(""))
    plain = F.trim(F.regexp_replace(without(F.lower(raw), NOT_OF_A_COURSE), r"\s+", " "))
    return token, plain, F.split_part(plain, F.lit(" "), F.lit(1))


def to_int(x: str | Column) -> Column:
    """The whole part of the first number in a text, else null."""
    number = F.nullif(F.regexp_extract(_col(x), r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.coalesce(_col(x).try_cast("double"), number.try_cast("double")).try_cast("int")


def to_number(x: str | Column) -> Column:
    """A text as a number, else the first number in it, else null."""
    number = F.nullif(F.regexp_extract(_col(x), r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.coalesce(_col(x).try_cast("double"), number.try_cast("double"))


def whole(x: str | Column) -> Column:
    """The whole part of a text that is a number, else null."""
    return _col(x).try_cast("double").try_cast("int")


def race_class(x: str | Column) -> Column:
    """A race's class: a text that is a number, else the first digits in it, else null."""
    return F.coalesce(whole(x), F.nullif(F.regexp_extract(_col(x), r"(\d+)", 1), F.lit("")).try_cast("int"))


def free_time(x: str | Column) -> Column:
    """A time as people write it, in UTC: ISO, or with the month's number first unless it can't be, or its name."""
    said = F.initcap(F.regexp_replace(F.trim(_col(x)), r"[\s./-]+", " "))
    patterns = [f"{day}[ H:mm[:ss]]" for day in ("M d yyyy", "d M yyyy", "d MMM yyyy", "MMM d yyyy", "d MMMM yyyy", "MMMM d yyyy")]
    return F.coalesce(F.trim(_col(x)).try_cast("timestamp"), *[F.try_to_timestamp(said, F.lit(p)) for p in patterns])


def race_kind(market: str | Column) -> Column:
    """Chase, Hurdle, NH Flat or Flat, by words in a market's name."""
    low = F.lower(F.coalesce(_col(market), F.lit("")))
    found = [F.when(low.rlike("|".join(words)), kind) for kind, words in RACE_KINDS.items()]
    return F.coalesce(*found, F.lit("Flat"))


def course_country(course: str | Column) -> Column:
    """IE for a course whose name has that of an Irish one, else GB."""
    return F.when(F.lower(_col(course)).rlike("|".join(IRISH_COURSES)), "IE").otherwise("GB")


def is_handicap(x: str | Column) -> Column:
    text = F.lower(F.coalesce(_col(x), F.lit("")))
    return text.contains("hcap") | text.contains("handicap")


def non_completion(position: str | Column) -> Column:
    """The code in a position that is no number, upper-cased."""
    text = F.upper(F.trim(_col(position)))
    return F.when((text != "") & ~text.rlike(r"^[0-9.]+$"), text)


def is_win(flag: str | Column, position: str | Column) -> Column:
    """From a win flag's text if there is one, else from the position."""
    text = F.lower(F.trim(_col(flag)))
    return F.when(F.length(text) > 0, text.isin("1", "true", "win", "w")).otherwise(F.coalesce(to_int(position) == 1, F.lit(False)))


def furlongs(x: str | Column) -> Column:
    """``2m 4f`` in furlongs; null without either unit."""
    text = F.lower(_col(x))
    miles, rest = (F.nullif(F.regexp_extract(text, rf"(\d+)\s*{u}", 1), F.lit("")).try_cast("double") for u in "mf")
    return F.when(miles.isNotNull() | rest.isNotNull(), F.coalesce(miles, F.lit(0.0)) * 8 + F.coalesce(rest, F.lit(0.0)))


def going_name(x: str | Column) -> Column:
    """What is before a bracket, each word capitalised."""
    return F.initcap(F.trim(F.split_part(_col(x), F.lit("("), F.lit(1))))


def surface_of(going: str | Column) -> Column:
    text = F.lower(F.coalesce(_col(going), F.lit("")))
    return F.when(text.rlike("standard|slow|fast"), "AW").otherwise("Turf")


def grade_of(x: str | Column) -> Column:
    """``Group n`` or ``Grade n`` in a title, else Listed, else null."""
    found = F.nullif(F.initcap(F.regexp_replace(F.regexp_extract(_col(x), r"(?i)\b((?:group|grade)\s+\d)\b", 1), r"\s+", " ")), F.lit(""))
    return F.coalesce(found, F.when(F.lower(_col(x)).contains("listed"), "Listed"))


def decision_cutoff(off: str | Column) -> Column:
    """21:00 UTC on the day before."""
    return F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", _col(off))) - 3 * 3600)


def london_time(ts: str | Column) -> Column:
    return F.date_format(F.from_utc_timestamp(_col(ts), "Europe/London"), "HH:mm")


def minutes_apart(a: str | Column, b: str | Column) -> Column:
    """Minutes between two times of day written HH:mm."""

    def minutes(x: Column) -> Column:
        return F.split_part(x, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(x, F.lit(":"), F.lit(2)).try_cast("int")

    return F.abs(minutes(_col(a)) - minutes(_col(b)))


def verdict(x: str | Column, allowed: list[str]) -> Column:
    """The ``verdict`` of the JSON object in a text, if it is an allowed one."""
    body = F.regexp_extract(_col(x), r"(?s)(\{.*\})", 1)
    value = F.upper(F.get_json_object(body, "$.verdict"))
    return F.when(value.isin(allowed), value)


def _sql_without(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, r'{p}', '')"
    return x


def _sql_map(values: dict[str, str]) -> str:
    return f"map({', '.join(repr(v) for kv in values.items() for v in kv)})"


def sql_bodies() -> dict[str, str]:
    """The normalisers as SQL over x, from the same patterns and values."""
    token = f"nullif(regexp_extract(lower(trim(x)), r'{EVENT}', 1), '')"
    plain = rf"trim(regexp_replace({_sql_without('lower(trim(x))', NOT_OF_A_COURSE)}, r'\s+', ' '))"
    tokens, aliases = _sql_map(VENUE_TOKENS), _sql_map(COURSE_ALIASES)
    kept = rf"regexp_replace(lower(trim({_sql_without('trim(x)', NOT_OF_A_HORSE)})), r'[^a-z0-9\s_-]', '')"
    slug = rf"regexp_replace(regexp_replace({kept}, r'[\s-]+', '_'), '^_+|_+$', '')"
    return {
        "normalise_course": f"coalesce({tokens}[{token}], {aliases}[{token}], {token}, {aliases}[{plain}], {aliases}[split_part({plain}, ' ', 1)], {plain})",
        "normalise_horse": slug,
    }


def register(spark: SparkSession) -> None:
    """Make the normalisers callable from SQL; registering again replaces them."""
    for name, body in sql_bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")


def venue_shown(x: str | Column) -> Column:
    """A course's name for display: without a day and month at its end."""
    return F.regexp_replace(_col(x), r"\s+\d+\w*\s+\w+$", "")


def first_word(x: str | Column) -> Column:
    return F.split_part(_col(x), F.lit(" "), F.lit(1))


def relative_day(word: str | Column) -> Column:
    """today, tomorrow or yesterday as a date; another text as the date it is, else null."""
    text, now = F.lower(F.trim(_col(word))), F.current_date()
    return F.when(text == "today", now).when(text == "tomorrow", F.date_add(now, 1)).when(text == "yesterday", F.date_add(now, -1)).otherwise(text.try_cast("date"))

"""Types of articles: by categories, infobox, first sentence, ship names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlaswright.functions.text import tokens

# fixed values: type, priority and words, in order of precedence
TYPES = {
    "NONE": (-1, ""),
    "SHIP": (-1, "ship, ships, warship, warships, frigate, frigates, submarine, submarines, aircraft carrier, aircraft carriers, freighter, freighter, caravel, caravels, galleon, galleons, galley, galleys, ironclad, ironclads, battleship, battleships, cruiser, cruisers, destroyer, destroyers, steamship, steamships, fleet, fleets"),
    "PERSON": (-1, ""),
    "LAND": (0, "island, islands, peninsula, archipelago, massif"),
    "SEA": (0, "ocean, oceans, sea, seas"),
    "COUNTRY": (1, "country, countries, kingdom, empire, monarchy, republic"),
    "STATE": (2, "state, states"),
    "AUTONOMOUS": (3, "autonomy, autonomies, microstate, microstates, canton, cantons"),
    "REGION": (4, "region, regions, province, provinces, area, areas, county, counties, territory, territories, sites, sites"),
    "NATURE": (4, "lake, lakes, swamp, swamps, ridge, ridges, mountain, mountains, river, rivers, stream, streams, affluent, affluents, creek, creeks, hill, hills, valley, valleys, coral, corals, reef, glen, glens"),
    "SETTLEMENT": (5, "city, cities, capital, capitals, town, towns, village, villages, commune, communes, port, ports, settlement, settlements, municipal, municipality, colony, colonies, hamlet, hamlets, borough, boroughs, suburb, suburbs, metropolis, neighborhood, neighborhoods"),
    "SPOT": (6, "house, museum, stadium, statue, monument, sculpture, building, tower, castle, farm, square, fort, citadel, hotel, motel, memorial, landmark, garden, factory, university, college, theater, theatre, apartment, palace, temple, cathedral, mosque, synagogue, bridge, fountain, tomb, church, chapel, campus, plantation, hospital, estate, shipyard, station, airport, cemetery, graveyard, residence, mall, observatory, street, avenue, zoo"),
}
PERSON_CATEGORIES = r"\d+s?_births|\d+s?_deaths|People_(from|in|of)|Living_people|_alumni$"
SETTLEMENT_TYPE = r"\| *settlement_type *=(.*?)\R"
VERBS = ["is", "was", "are", "were"]
STOP_AT = ["in", "of", "that", "at", "on"]
NO_SHIPS = ["scholarship)", "fellowship)", "ownership)", "membership)"]

PRIORITY = {name: p for name, (p, _) in TYPES.items()}
VARIANTS = {name: list(dict.fromkeys(w.strip() for w in words.split(",") if w.strip())) for name, (_, words) in TYPES.items()}
NEAR_VERB = 5
FIRST_WORDS = 50


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def type_table(spark) -> DataFrame:  # noqa: ANN001
    """``type, priority, ordinal, variant``."""
    return spark.createDataFrame([(t, PRIORITY[t], k, v) for k, t in enumerate(TYPES) for v in VARIANTS[t]], "type string, priority int, ordinal int, variant string")


def type_from_categories(categories: Column) -> Column:
    """The first type with a plural that a category equals or, before ``_in_`` or ``_of_``, begins with; else PERSON by telling names; else null."""
    clean = F.transform(categories, lambda c: F.trim(F.lower(F.regexp_replace(c, "^[0-9_-]+", ""))))
    hits = []
    for name, words in VARIANTS.items():
        plural = "|".join(w.replace(" ", "_") for w in words if w.endswith("s"))
        if plural:
            hits.append(F.when(F.exists(clean, _plural_test(plural)), name))
    hits.append(F.when(F.exists(categories, lambda c: c.rlike(PERSON_CATEGORIES)), "PERSON"))
    return F.coalesce(*hits)


def _plural_test(plural: str):  # noqa: ANN202
    return lambda c: c.rlike(f"^({plural})$") | (c.rlike(f"^({plural})") & c.rlike("_(in|of)_"))


def type_from_infobox(raw: Column) -> Column:
    """The type of highest priority named by a settlement infobox; a capital is a settlement; null without one."""
    line = F.regexp_replace(F.trim(F.regexp_extract(raw, SETTLEMENT_TYPE, 1)), r"^\[\[|]]$", "")
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(F.regexp_replace(F.trim(F.lower(p)), "^list of ", "")))

    def of(part: Column, k: Column) -> Column:
        by_start = F.array(*[F.when(part.rlike("^(" + "|".join(words) + ")"), _hit(name, n, k)) for n, (name, words) in enumerate(VARIANTS.items()) if words])
        return F.when(F.contains(part, F.lit(" capital")), F.array(_hit("SETTLEMENT", list(TYPES).index("SETTLEMENT"), k))).otherwise(by_start)

    hits = F.flatten(F.transform(parts, of))
    return F.array_max(F.array_compact(hits))["type"]


def _hit(name: str, ordinal: int, part: Column) -> Column:
    return F.struct(F.lit(PRIORITY[name]).alias("priority"), part.alias("part"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("type"))


def type_from_text(clean: Column, categories: Column) -> Column:
    """The type said in the first sentence: within five words of its first verb, before a preposition.

    ``united states`` says nothing; of two type words in a row the second counts if it is of higher priority. COUNTRY and STATE
    need a category of countries or states.
    """
    owner = {v: name for name in reversed(TYPES) for v in VARIANTS[name]}
    types, priorities = _map(owner), _map(PRIORITY)
    words = F.slice(tokens(clean), 1, FIRST_WORDS)
    verb = F.array_min(F.filter(F.array(*[F.array_position(words, F.lit(v)) for v in VERBS]), lambda p: p > 0)).cast("int")
    lower = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    has = lambda w: F.exists(lower, lambda c: c.startswith(w) & c.rlike("_(in|of)_"))
    valid = lambda t: F.when(t == "COUNTRY", has("countries")).when(t == "STATE", has("states")).otherwise(t.isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(False).alias("over"))

    def step(state: Column, k: Column) -> Column:
        i = verb - 1 + k
        word = F.get(words, i)
        one, two = F.try_element_at(types, word), F.try_element_at(types, F.get(words, i + 1))
        better = two.isNotNull() & (F.try_element_at(priorities, two) > F.try_element_at(priorities, one)) & valid(two)
        found = F.when(one.isNull() | ((word == "states") & (F.get(words, i - 1) == "united")), F.lit(None)).when(better, two).when(valid(one), one)
        stop = word.isNull() | word.isin(STOP_AT)
        return F.when(state["over"], state).otherwise(F.struct(F.when(~stop, found).cast("string").alias("type"), (stop | found.isNotNull()).alias("over")))

    scan = F.aggregate(F.sequence(F.lit(0), F.lit(NEAR_VERB - 1)), none, step, lambda s: s["type"])
    return F.when(verb.isNotNull(), scan)


def type_from_name(title: Column) -> Column:
    """SHIP for titles ending in ``ship)`` that is no scholarship or the like."""
    no = F.lit(False)
    for w in NO_SHIPS:
        no = no | F.lower(title).endswith(w)
    return F.when(F.lower(title).endswith("ship)") & ~no, "SHIP")


def article_type(title: Column, raw: Column, clean: Column, categories: Column) -> Column:
    """The first of the four rules that says something, else NONE."""
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    return F.coalesce(type_from_categories(cats), type_from_infobox(raw), type_from_text(clean, cats), type_from_name(title), F.lit("NONE"))


def article_types(pages: DataFrame) -> DataFrame:
    """``title, type`` from ``title, raw, clean, categories``: the first of the four rules that says something, else NONE."""
    kind = article_type(F.col("title"), F.col("raw"), F.col("clean"), F.col("categories"))
    return pages.where("title is not null").select("title", kind.alias("type"))

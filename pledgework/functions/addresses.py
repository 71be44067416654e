"""the words of a street address, tagged together by the cheapest path (Viterbi) in array functions; no Python in the rows.

Each word has a class by its look (number, fraction, direction, street word, route word, unit word, other). A path gives each word a
tag; it costs what the class says against the tag, plus what the step from the last tag costs. Whole lines are weighed, so that a
number is the house's at the start, a route's after HIGHWAY and a unit's after APT, and a direction or street word may be the name
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.scratch import written

#: Words by their class; the rest of a street's words are its name.
DIRECTIONS = "N S E W NE NW SE SW NORTH SOUTH EAST WEST NORTHEAST NORTHWEST SOUTHEAST SOUTHWEST".split()
STREET_WORDS = "ST STREET AVE AVENUE RD ROAD DR DRIVE BLVD BOULEVARD LN LANE CT COURT PL PLACE WAY TER TERRACE CIR CIRCLE PKWY PARKWAY TRL TRAIL SQ SQUARE LOOP PIKE PATH ROW RUN".split()
ROUTE_WORDS = "HWY HIGHWAY RTE ROUTE RT FM CR INTERSTATE US".split()
UNIT_WORDS = "APT APARTMENT UNIT STE SUITE # RM ROOM FL FLOOR LOT BLDG BUILDING SPC TRLR".split()

TAGS = ("number", "fraction", "street", "direction", "type", "unit_word", "unit")
#: What a word of a class costs under each tag; what isn't named costs FAR.
FAR = 9.0
LOOKS = {
    "number": {"number": 0.0, "street": 2.0, "unit": 0.5},
    "fraction": {"fraction": 0.0, "unit": 4.0},
    "direction": {"direction": 0.2, "street": 1.5, "unit": 2.5},
    "type": {"type": 0.2, "street": 1.2, "unit": 4.0},
    "route": {"street": 0.3, "unit": 6.0},
    "unit_word": {"unit_word": 0.0, "street": 5.0},
    "word": {"street": 0.3, "unit": 2.0},
}
#: What a step from one tag to the next costs; what isn't named costs FAR. The first word comes after "start".
STEPS = {
    "start": {"number": 0.0, "street": 4.0, "direction": 4.0, "unit_word": 3.0},
    "number": {"fraction": 0.0, "street": 0.2, "direction": 0.2, "type": 2.0},
    "fraction": {"street": 0.2, "direction": 0.2},
    "street": {"street": 0.3, "type": 0.0, "direction": 0.8, "unit_word": 0.5, "unit": 6.0},
    "direction": {"street": 0.0, "type": 2.0, "direction": 1.0, "unit_word": 0.5, "unit": 6.0},
    "type": {"direction": 0.3, "unit_word": 0.0, "street": 1.5, "type": 2.0, "unit": 2.8},
    "unit_word": {"unit": 0.0, "unit_word": 1.0},
    "unit": {"unit": 1.5, "unit_word": 1.0},
}


def words(line: Column) -> Column:
    """Upper-case words; the sign of a unit is a word of its own, other marks but hyphens and slashes are none."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(line, F.lit(""))), "#", " # "), r"[^A-Z0-9#/ -]", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def look(w: Column) -> Column:
    return (
        F.when(w.rlike(r"^\d+/\d+$"), "fraction")
        .when(w.rlike(r"^\d+[A-Z]?(-\d+[A-Z]?)?$"), "number")
        .when(w.isin(*UNIT_WORDS), "unit_word")
        .when(w.isin(*DIRECTIONS), "direction")
        .when(w.isin(*STREET_WORDS), "type")
        .when(w.isin(*ROUTE_WORDS), "route")
        .otherwise("word")
    )


def looks_of(line: Column) -> Column:
    return F.transform(words(line), look)


def tags_of(looks: Column) -> Column:
    """The tags of a line by the classes of its words: the cheapest path; of equal ones the tag that stands first in TAGS."""
    path = "struct<cost:double,tags:array<string>>"

    def emission(kind: Column, tag: str) -> Column:
        out = F.lit(FAR)
        for k, costs in LOOKS.items():
            out = F.when(kind == k, F.lit(costs.get(tag, FAR))).otherwise(out)
        return out

    def step(before: Column, kind: Column) -> Column:
        """The cheapest path to each tag of this word, from the cheapest paths to each tag of the last."""
        ends = []
        for tag in TAGS:
            ways = [F.struct((before[i]["cost"] + F.lit(STEPS[prior].get(tag, FAR))).alias("cost"), F.lit(i).alias("prior")) for i, prior in enumerate(TAGS)]
            first = F.struct(F.lit(STEPS["start"].get(tag, FAR)).alias("cost"), F.lit(0).alias("prior"))
            best = F.when(F.size(before[0]["tags"]) == 0, first).otherwise(F.array_min(F.array(*ways)))
            ends.append((best["cost"] + emission(kind, tag), F.get(before, best["prior"])["tags"], tag))
        return F.array(*[F.struct(c.alias("cost"), F.concat(t, F.array(F.lit(tag))).alias("tags")).cast(path) for c, t, tag in ends])

    none = F.array(*[F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("tags")) for _ in TAGS]).cast(f"array<{path}>")
    last = F.aggregate(looks, none, step)
    best = F.array_min(F.transform(last, lambda p, i: F.struct(p["cost"].alias("cost"), i.alias("i"), p["tags"].alias("tags"))))
    return best["tags"]


def parts(line: Column, tags: Column | None = None) -> Column:
    """A struct of number, street and unit of a line, words with single spaces between; an empty text for what it hasn't. Without tags, the path is sought for each row; see with_parts()."""
    tags = tags_of(looks_of(line)) if tags is None else tags

    def said(found: Column) -> Column:
        of = lambda *names: F.array_join(F.transform(F.filter(found, lambda x: x["tag"].isin(*names)), lambda x: x["word"]), " ")
        return F.struct(of("number").alias("number"), of("street", "direction", "type").alias("street"), of("unit").alias("unit"))

    found = F.zip_with(words(line), tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    return F.get(F.transform(F.array(found), said), F.lit(0))


def with_parts(df: DataFrame, line: Column, name: str, few: int = 100_000) -> DataFrame:
    """The rows with parts() of a line. A path depends on the classes of the words only, and lines have few different sequences of classes: each is solved once, and the rows get their tags by a join, which is a broadcast while the sequences are few."""
    # small files are read by one task, whatever work their rows make
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    marked = dealt.withColumn("_looks", F.array_join(looks_of(line), " "))
    forms = written(marked.select("_looks").distinct(), "forms")
    solved = written(forms.withColumn("_tags", tags_of(F.filter(F.split("_looks", " "), lambda k: k != ""))), "solved-forms")
    solved = F.broadcast(solved) if solved.count() <= few else solved
    return marked.join(solved, "_looks").withColumn(name, parts(line, F.col("_tags"))).drop("_looks", "_tags")

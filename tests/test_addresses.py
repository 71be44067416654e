"""Street addresses of every form, tagged by the cheapest path."""

import itertools

from pyspark.sql import functions as F

from pledgework.functions import addresses as A

CASES = {
    "12 North Main Street": ("12", "NORTH MAIN STREET", ""),
    "12 1/2 Main St": ("12", "MAIN ST", ""),
    "12 Main St, Apt. #4": ("12", "MAIN ST", "4"),
    "12 Main St #4B": ("12", "MAIN ST", "4B"),
    "12 main st Suite 200 Bldg C": ("12", "MAIN ST", "200 C"),
    "1200 Highway 50 West": ("1200", "HIGHWAY 50 WEST", ""),
    "45 County Road 12 Lot 3": ("45", "COUNTY ROAD 12", "3"),
    "7 W 42nd St Fl 9": ("7", "W 42ND ST", "9"),
    "19 North St": ("19", "NORTH ST", ""),
    "19 Avenue B": ("19", "AVENUE B", ""),
    "123-45A Queens Blvd": ("123-45A", "QUEENS BLVD", ""),
    "88 Martin Luther King Jr Blvd NE Unit 12A": ("88", "MARTIN LUTHER KING JR BLVD NE", "12A"),
    "12 Main St 4B": ("12", "MAIN ST", "4B"),
    "Main Street": ("", "MAIN STREET", ""),
    "": ("", "", ""),
    "5 Park Place Drive": ("5", "PARK PLACE DRIVE", ""),
}


def test_forms_of_addresses(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "line string")
    got = {r["line"]: tuple(r["p"]) for r in rows.select("line", A.parts(F.col("line")).alias("p")).collect()}
    many = A.with_parts(rows, F.col("line"), "p").select("line", "p")
    assert {r["line"]: tuple(r["p"]) for r in many.collect()} == got and many.columns == ["line", "p"]
    assert got.pop(None) == ("", "", "")
    assert got == CASES


def test_the_path_is_the_cheapest(spark):
    lines = ["12 N ST APT 4", "12 1/2 HWY 9 W", "N 5 AVE # B"]
    looks = spark.createDataFrame([(x,) for x in lines], "line string").select("line", A.looks_of(F.col("line")).alias("k"), A.tags_of(A.looks_of(F.col("line"))).alias("t")).collect()

    def cost(kinds, tags):
        return sum(A.LOOKS[k].get(t, A.FAR) + A.STEPS[b].get(t, A.FAR) for k, b, t in zip(kinds, ["start", *tags], tags))

    for r in looks:
        least = min(cost(r["k"], tags) for tags in itertools.product(A.TAGS, repeat=len(r["k"])))
        assert abs(cost(r["k"], r["t"]) - least) < 1e-9


def test_lines_of_one_partition_are_read_by_many_tasks(spark):
    from pledgework.functions import addresses

    few = spark.range(0, 40, 1, 1).selectExpr("id", "concat(id, ' Main St') AS line")
    got = addresses.with_parts(few, few["line"], "found")
    assert got.rdd.getNumPartitions() > 1 and got.count() == 40

"""Programs of two query languages, answered over worlds made of the star schema.

In the atlas nations are states, regions countries, suppliers cities, customers places
(mountains and lakes by segment) and brands rivers. In the blocks world parts are
blocks. Each query answers a list of programs: (program, id, value), ids of things or
numbers of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, table
from ..plans import funql, lambda_dcs
from ..plans.worlds import World

#: Distance of keys up to which nations of one region border, and quantity and discount from which a line makes a brand traverse a nation.
BORDER, HEAVY, CHEAP, LEAST_PRICE = 6, 49, 0.08, 90_000
#: Properties of blocks whose values are numbers.
NUMERIC = ("width", "height", "length")


def atlas(spark: SparkSession, sf_dir: str) -> World:
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda kind, name: F.concat(F.lit(f"{kind}:"), F.col(name)).alias("id")
    thing = lambda df, kind, name, *more: [df.select(tag(kind, name), F.lit(k).alias("kind"), F.col(name).alias("name")) for k in (kind, *more)]
    nation, region, supplier, customer, part = t("nation"), t("region"), t("supplier"), t("customer"), t("part")
    brands = part.select(F.col("p_brand").alias("brand")).distinct()
    of_nation = nation.select("n_nationkey", "n_regionkey", tag("state", "n_name").alias("state")).join(region.select(F.col("r_regionkey").alias("n_regionkey"), tag("country", "r_name").alias("country")), "n_regionkey")
    home = lambda df, key: df.join(F.broadcast(of_nation.withColumnRenamed("n_nationkey", key)), key)  # noqa: E731  nations are 25
    city = home(supplier, "s_nationkey").select(tag("city", "s_name"), "state", "country", "s_suppkey", "s_acctbal")
    place = home(customer, "c_nationkey").select(tag("place", "c_name"), "state", "country", "c_custkey", "c_acctbal", "c_mktsegment")
    first = city.groupBy("state").agg(F.min_by("id", "s_suppkey").alias("b"))
    high = place.groupBy("state").agg(F.max_by("id", F.struct("c_acctbal", F.col("c_custkey"))).alias("b"))
    low = place.groupBy("state").agg(F.min_by("id", F.struct("c_acctbal", F.col("c_custkey"))).alias("b"))
    things = [
        *thing(nation, "state", "n_name"), *thing(region, "country", "r_name"), *thing(supplier, "city", "s_name"), *thing(customer, "place", "c_name"), *thing(brands, "river", "brand"),
        place.filter("c_mktsegment = 'BUILDING'").select("id", F.lit("mountain").alias("kind"), F.lit(None).cast("string").alias("name")),
        place.filter("c_mktsegment = 'MACHINERY'").select("id", F.lit("lake").alias("kind"), F.lit(None).cast("string").alias("name")),
        first.select(F.col("b").alias("id"), F.lit("capital").alias("kind"), F.lit(None).cast("string").alias("name")),
        city.filter("s_acctbal > 5000").select("id", F.lit("major").alias("kind"), F.lit(None).cast("string").alias("name")),
    ]
    link = lambda df, relation, a, b: df.select(F.lit(relation).alias("relation"), F.col(a).alias("a"), F.col(b).alias("b"))
    near = of_nation.select(F.col("n_regionkey"), F.col("n_nationkey").alias("ka"), F.col("state").alias("a")).join(of_nation.select("n_regionkey", F.col("n_nationkey").alias("kb"), F.col("state").alias("b")), "n_regionkey")
    heavy = t("lineitem").filter((F.col("l_quantity") >= HEAVY) & (F.col("l_discount") >= CHEAP) & (F.col("l_extendedprice") >= LEAST_PRICE)).select("l_partkey", "l_suppkey")
    runs = heavy.join(part.select("p_partkey", tag("river", "p_brand")), F.col("l_partkey") == F.col("p_partkey")).join(city.select("s_suppkey", "state"), F.col("l_suppkey") == F.col("s_suppkey"))
    links = [
        link(city, "loc", "id", "state"), link(city, "loc", "id", "country"), link(place, "loc", "id", "state"), link(place, "loc", "id", "country"), link(of_nation, "loc", "state", "country"),
        link(near.filter((F.col("ka") != F.col("kb")) & (F.abs(F.col("ka") - F.col("kb")) <= BORDER)), "next_to", "a", "b"),
        link(runs, "traverse", "id", "state").distinct(), link(first, "capital", "state", "b"), link(high, "high_point", "state", "b"), link(low, "low_point", "state", "b"),
    ]
    number = lambda df, attribute, value: df.select("id", F.lit(attribute).alias("attribute"), value.cast("double").alias("value"))
    cities = city.groupBy(F.col("state").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    places = place.groupBy(F.col("state").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    states = cities.join(places.withColumnRenamed("n", "m"), "id")
    long_ = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("x")).select(tag("river", "p_brand"), "x")
    numbers = [
        number(city, "population", F.col("s_acctbal")), number(city, "size", F.col("s_acctbal")), number(place, "elevation", F.col("c_acctbal")), number(place, "size", F.col("c_acctbal")),
        number(states, "population", F.col("n")), number(states, "area", F.col("m")), number(states, "size", F.col("m")), number(states, "density", F.col("n") / F.col("m")),
        number(long_, "length", F.col("x")), number(long_, "size", F.col("x")),
    ]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return World(*(checkpointed(union(x)) for x in (things, links, numbers)))  # every program reads them


def blocks(spark: SparkSession, sf_dir: str) -> World:
    """Parts as blocks: brand, size and container-like type are colour, width and shape; the next part stands left of one, the seventh next above it."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("en.block."), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    kinds = [p.select("id", F.lit("en.block").alias("kind")), p.select(F.concat(F.lit("en.color."), "p_brand").alias("id"), F.lit("en.color").alias("kind")).distinct(), p.select(F.concat(F.lit("en.shape."), "p_type").alias("id"), F.lit("en.shape").alias("kind")).distinct()]
    link = lambda relation, b: p.select(F.lit(relation).alias("relation"), F.col("id").alias("a"), b.alias("b"))
    other = lambda relation, step: p.select(F.lit(relation).alias("relation"), F.col("id").alias("a"), (F.col("p_partkey") + step).alias("k")).join(p.select(F.col("p_partkey").alias("k"), F.col("id").alias("b")), "k").select("relation", "a", "b")
    links = [link("color", F.concat(F.lit("en.color."), "p_brand")), link("shape", F.concat(F.lit("en.shape."), "p_type")), other("left", 1), other("above", 7), link("is_special", F.lit("true")).join(p.filter("p_size = 1").select(F.col("id").alias("a")), "a", "left_semi").select("relation", "a", "b")]
    number = lambda attribute, value: p.select("id", F.lit(attribute).alias("attribute"), value.cast("double").alias("value"))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    numbers = [number("width", F.col("p_size")), number("length", F.col("p_size") * 2), number("height", F.col("p_retailprice"))]
    return World(checkpointed(union(kinds).withColumn("name", F.col("id"))), checkpointed(union(links)), checkpointed(union(numbers)))


def answers(programs: Iterable[str], denote: Callable[[str], DataFrame]) -> DataFrame:
    """(program, id, value) of all programs."""
    found = [denote(p).select(F.lit(p).alias("program"), F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value")) for p in programs]
    return reduce(DataFrame.unionByName, found)


#: Programs and what they mean, as SQL over the views of ATLAS; one of each operator.
SETS = {
    "answer(state(all))": "SELECT id FROM things WHERE kind = 'state'",
    "answer(city(cityid('Supplier#000000003', _)))": "SELECT id FROM things WHERE kind = 'city' AND name = 'Supplier#000000003'",
    "answer(state(loc_1(cityid('Supplier#000000003', 'NATION_3'))))": "SELECT DISTINCT b AS id FROM links JOIN things ON id = b WHERE relation = 'loc' AND kind = 'state' AND a IN (SELECT t.id FROM things t JOIN links l ON l.a = t.id WHERE t.kind = 'city' AND t.name = 'Supplier#000000003' AND l.relation = 'loc' AND l.b = 'state:NATION_3')",
    "answer(city(loc_2(stateid('NATION_8'))))": "SELECT a AS id FROM links JOIN things ON id = a WHERE relation = 'loc' AND b = 'state:NATION_8' AND kind = 'city'",
    "answer(major(city(loc_2(countryid('ASIA')))))": "SELECT a AS id FROM links JOIN things ON id = a WHERE relation = 'loc' AND b = 'country:ASIA' AND kind = 'major'",
    "answer(country(loc_1(stateid('NATION_11'))))": "SELECT b AS id FROM links WHERE relation = 'loc' AND a = 'state:NATION_11'",
    "answer(state(next_to_1(stateid('NATION_12'))))": "SELECT b AS id FROM links WHERE relation = 'next_to' AND a = 'state:NATION_12'",
    "answer(state(next_to_2(stateid('NATION_12'))))": "SELECT a AS id FROM links WHERE relation = 'next_to' AND b = 'state:NATION_12'",
    "answer(river(traverse_2(stateid('NATION_13'))))": "SELECT a AS id FROM links WHERE relation = 'traverse' AND b = 'state:NATION_13'",
    "answer(state(traverse_1(riverid('Brand#11'))))": "SELECT b AS id FROM links WHERE relation = 'traverse' AND a = 'river:Brand#11'",
    "answer(capital_1(stateid('NATION_17')))": "SELECT b AS id FROM links WHERE relation = 'capital' AND a = 'state:NATION_17'",
    "answer(state(capital_2(city(capital(all)))))": "SELECT a AS id FROM links WHERE relation = 'capital'",
    "answer(high_point_1(stateid('NATION_5')))": "SELECT b AS id FROM links WHERE relation = 'high_point' AND a = 'state:NATION_5'",
    "answer(state(low_point_2(low_point_1(state(all)))))": "SELECT DISTINCT l.a AS id FROM links l WHERE relation = 'low_point'",
    "answer(intersection(next_to_2(stateid('NATION_12')), loc_2(countryid('ASIA'))))": "SELECT a AS id FROM links WHERE relation = 'next_to' AND b = 'state:NATION_12' AND a IN (SELECT a FROM links WHERE relation = 'loc' AND b = 'country:ASIA')",
    "answer(exclude(state(all), loc_2(countryid('ASIA'))))": "SELECT id FROM things WHERE kind = 'state' AND id NOT IN (SELECT a FROM links WHERE relation = 'loc' AND b = 'country:ASIA')",
}
TOP = "SELECT id FROM ({}) WHERE value = (SELECT {}(value) FROM ({}))"
_of = lambda inner, attribute: f"SELECT id, value FROM numbers WHERE attribute = '{attribute}' AND id IN ({inner})"
_end = lambda inner, attribute, f: TOP.format(_of(inner, attribute), f, _of(inner, attribute))
_all = lambda kind: f"SELECT id FROM things WHERE kind = '{kind}'"
_most = lambda rows, f: f"WITH c AS ({rows}) SELECT id FROM c WHERE n = (SELECT {f}(n) FROM c)"
EXTREMES = {
    "answer(largest(state(all)))": _end(_all("state"), "size", "max"),
    "answer(smallest(city(all)))": _end(_all("city"), "size", "min"),
    "answer(highest(place(loc_2(stateid('NATION_10')))))": _end("SELECT a FROM links WHERE relation = 'loc' AND b = 'state:NATION_10'", "elevation", "max"),
    "answer(lowest(lake(all)))": _end(_all("lake"), "elevation", "min"),
    "answer(longest(river(all)))": _end(_all("river"), "length", "max"),
    "answer(shortest(river(all)))": _end(_all("river"), "length", "min"),
    "answer(largest_one(population_1(city(all))))": _end(_all("city"), "population", "max"),
    "answer(smallest_one(density_1(state(all))))": _end(_all("state"), "density", "min"),
    "answer(most(state(loc_1(city(all)))))": _most("SELECT b AS id, count(DISTINCT a) AS n FROM links WHERE relation = 'loc' AND a LIKE 'city:%' AND b LIKE 'state:%' GROUP BY b", "max"),
    "answer(fewest(state(next_to_2(state(all)))))": _most("SELECT a AS id, count(DISTINCT b) AS n FROM links WHERE relation = 'next_to' GROUP BY a", "min"),
    "answer(longer(riverid('Brand#23')))": "SELECT id FROM numbers WHERE attribute = 'length' AND value > (SELECT value FROM numbers WHERE attribute = 'length' AND id = 'river:Brand#23')",
    "answer(mountain(higher_2(placeid('Customer#000000007'))))": "SELECT id FROM numbers WHERE attribute = 'elevation' AND value > (SELECT value FROM numbers WHERE attribute = 'elevation' AND id = 'place:Customer#000000007') AND id IN (SELECT id FROM things WHERE kind = 'mountain')",
    "answer(lower_2(lowest(place(all))))": "SELECT id FROM numbers WHERE false",
}
NUMBERS = {
    "answer(count(city(all)))": "SELECT count(*) FROM things WHERE kind = 'city'",
    "answer(sum(population_1(state(all))))": "SELECT sum(value) FROM numbers WHERE attribute = 'population' AND id LIKE 'state:%'",
    "answer(smallest(len(river(all))))": "SELECT min(value) FROM numbers WHERE attribute = 'length'",
    "answer(count(traverse_2(stateid('NATION_13'))))": "SELECT count(*) FROM links WHERE relation = 'traverse' AND b = 'state:NATION_13'",
}
VALUES = {
    "answer(population_1(stateid('NATION_8')))": ("population", "'state:NATION_8'"),
    "answer(area_1(state(next_to_2(stateid('NATION_12')))))": ("area", "SELECT a FROM links WHERE relation = 'next_to' AND b = 'state:NATION_12'"),
    "answer(density_1(stateid('NATION_11')))": ("density", "'state:NATION_11'"),
    "answer(elevation_1(high_point_1(stateid('NATION_5'))))": ("elevation", "SELECT b FROM links WHERE relation = 'high_point' AND a = 'state:NATION_5'"),
    "answer(len(longest(river(all))))": ("length", "SELECT id FROM numbers WHERE attribute = 'length' AND value = (SELECT max(value) FROM numbers WHERE attribute = 'length')"),
    "answer(size(stateid('NATION_8')))": ("size", "'state:NATION_8'"),
}


def _funql(programs: Iterable[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        world = atlas(spark, sf_dir)
        return answers(programs, lambda p: funql.denotation(p, world))

    return run


_kept = "SELECT a FROM triples WHERE relation = '{}' AND b = '{}'"
_color = _kept.format("color", "en.color.Brand#23")
_red = "(filter (getProperty (singleton en.block) !type) color = en.color.Brand#23)"
DCS_SETS = {
    "(listValue (getProperty (singleton en.color) !type))": "SELECT DISTINCT b AS id FROM triples WHERE relation = 'color'",
    f"(listValue {_red})": f"SELECT a AS id FROM ({_color})",
    f"(listValue (filter {_red} is_special))": f"SELECT a AS id FROM triples WHERE relation = 'is_special' AND a IN ({_color})",
    f"(listValue (filter {_red} (ensureNumericProperty width) > (ensureNumericEntity 40 en.inch)))": f"SELECT id FROM numbers WHERE attribute = 'width' AND value > 40 AND id IN ({_color})",
    f"(listValue (filter {_red} left != en.block.5))": f"SELECT DISTINCT a AS id FROM triples WHERE relation = 'left' AND b <> 'en.block.5' AND a IN ({_color})",
    f"(listValue (superlative {_red} max (ensureNumericProperty height)))": f"SELECT id FROM numbers WHERE attribute = 'height' AND id IN ({_color}) AND value = (SELECT max(value) FROM numbers WHERE attribute = 'height' AND id IN ({_color}))",
    f"(listValue (getProperty {_red} (reverse above)))": f"SELECT DISTINCT a AS id FROM triples WHERE relation = 'above' AND b IN ({_color})",
    f"(listValue (getProperty {_red} shape))": f"SELECT DISTINCT b AS id FROM triples WHERE relation = 'shape' AND a IN ({_color})",
    "(listValue (concat en.block.3 en.block.4))": "SELECT unnest(['en.block.3', 'en.block.4']) AS id",
    "(listValue (countSuperlative (getProperty (singleton en.color) !type) max (reverse color)))": _most("SELECT b AS id, count(DISTINCT a) AS n FROM triples WHERE relation = 'color' GROUP BY b", "max"),
    f"(listValue (countSuperlative (getProperty (singleton en.shape) !type) max (reverse shape) {_red}))": _most(f"SELECT b AS id, count(DISTINCT a) FILTER (a IN ({_color})) AS n FROM triples WHERE relation = 'shape' GROUP BY b", "max"),
    "(listValue (countComparative (getProperty (singleton en.block) !type) left < 1))": "SELECT DISTINCT a AS id FROM triples WHERE relation = 'color' AND a NOT IN (SELECT a FROM triples WHERE relation = 'left')",
    f"(listValue (countComparative (getProperty (singleton en.shape) !type) (reverse shape) >= 2 {_red}))": f"SELECT b AS id FROM triples WHERE relation = 'shape' AND a IN ({_color}) GROUP BY b HAVING count(DISTINCT a) >= 2",
}
DCS_NUMBERS = {
    f"(listValue (_size {_red}))": f"SELECT count(*) FROM ({_color})",
    f"(listValue (aggregate max (getProperty {_red} width)))": f"SELECT max(value) FROM numbers WHERE attribute = 'width' AND id IN ({_color})",
    f"(listValue (aggregate min (getProperty {_red} length)))": f"SELECT min(value) FROM numbers WHERE attribute = 'length' AND id IN ({_color})",
    f"(listValue (aggregate sum (getProperty {_red} width)))": f"SELECT sum(DISTINCT value) FROM numbers WHERE attribute = 'width' AND id IN ({_color})",
    f"(listValue (aggregate avg (getProperty {_red} width)))": f"SELECT avg(DISTINCT value) FROM numbers WHERE attribute = 'width' AND id IN ({_color})",
    "(listValue (concat 3 en.inch 6 en.inch))": "SELECT unnest([3.0, 6.0])",
}


def _dcs(programs: Iterable[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        world = blocks(spark, sf_dir)
        return answers(programs, lambda p: lambda_dcs.denotation(p, world, NUMERIC))

    return run


ATLAS = f"""WITH sn AS (SELECT n_nationkey, n_regionkey, 'state:' || n_name AS state, 'country:' || r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
city AS (SELECT 'city:' || s_name AS id, s_name, state, country, s_suppkey, s_acctbal FROM supplier JOIN sn ON s_nationkey = n_nationkey),
place AS (SELECT 'place:' || c_name AS id, c_name, state, country, c_custkey, c_acctbal, c_mktsegment FROM customer JOIN sn ON c_nationkey = n_nationkey),
things AS (SELECT 'state:' || n_name AS id, 'state' AS kind, n_name AS name FROM nation UNION ALL SELECT 'country:' || r_name, 'country', r_name FROM region UNION ALL SELECT id, 'city', s_name FROM city UNION ALL SELECT id, 'place', c_name FROM place
 UNION ALL SELECT DISTINCT 'river:' || p_brand, 'river', p_brand FROM part UNION ALL SELECT id, CASE c_mktsegment WHEN 'BUILDING' THEN 'mountain' ELSE 'lake' END, NULL FROM place WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT arg_min(id, s_suppkey), 'capital', NULL FROM city GROUP BY state UNION ALL SELECT id, 'major', NULL FROM city WHERE s_acctbal > 5000),
links AS (SELECT 'loc' AS relation, id AS a, state AS b FROM city UNION ALL SELECT 'loc', id, country FROM city UNION ALL SELECT 'loc', id, state FROM place UNION ALL SELECT 'loc', id, country FROM place UNION ALL SELECT 'loc', state, country FROM sn
 UNION ALL SELECT 'next_to', x.state, y.state FROM sn x JOIN sn y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey AND abs(x.n_nationkey - y.n_nationkey) <= {BORDER}
 UNION ALL SELECT DISTINCT 'traverse', 'river:' || p_brand, state FROM lineitem JOIN part ON l_partkey = p_partkey JOIN city ON l_suppkey = s_suppkey WHERE l_quantity >= {HEAVY} AND l_discount >= {CHEAP} AND l_extendedprice >= {LEAST_PRICE}
 UNION ALL SELECT 'capital', state, arg_min(id, s_suppkey) FROM city GROUP BY state UNION ALL SELECT 'high_point', state, arg_max(id, (c_acctbal, c_custkey)) FROM place GROUP BY state UNION ALL SELECT 'low_point', state, arg_min(id, (c_acctbal, c_custkey)) FROM place GROUP BY state),
st AS (SELECT state AS id, n, m FROM (SELECT state, count(*) AS n FROM city GROUP BY state) JOIN (SELECT state, count(*) AS m FROM place GROUP BY state) USING (state)),
numbers AS (SELECT id, unnest(['population', 'size']) AS attribute, s_acctbal::DOUBLE AS value FROM city UNION ALL SELECT id, unnest(['elevation', 'size']), c_acctbal FROM place UNION ALL SELECT id, 'population', n FROM st UNION ALL SELECT id, unnest(['area', 'size']), m FROM st
 UNION ALL SELECT id, 'density', n / m FROM st UNION ALL SELECT 'river:' || p_brand, unnest(['length', 'size']), max(p_retailprice) FROM part GROUP BY p_brand)
"""
BLOCKS = """WITH p AS (SELECT 'en.block.' || p_partkey AS id, * FROM part),
triples AS (SELECT 'color' AS relation, id AS a, 'en.color.' || p_brand AS b FROM p UNION ALL SELECT 'shape', id, 'en.shape.' || p_type FROM p UNION ALL SELECT 'left', x.id, y.id FROM p x JOIN p y ON y.p_partkey = x.p_partkey + 1
 UNION ALL SELECT 'above', x.id, y.id FROM p x JOIN p y ON y.p_partkey = x.p_partkey + 7 UNION ALL SELECT 'is_special', id, 'true' FROM p WHERE p_size = 1),
numbers AS (SELECT id, 'width' AS attribute, p_size::DOUBLE AS value FROM p UNION ALL SELECT id, 'length', p_size * 2 FROM p UNION ALL SELECT id, 'height', p_retailprice FROM p)
"""


def _sql(with_: str, ids: dict[str, str], numbers: dict[str, str] | None = None, values: dict | None = None) -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [f"SELECT {q(p)} AS program, id, NULL::DOUBLE AS value FROM ({s})" for p, s in ids.items()]
    parts += [f"SELECT {q(p)} AS program, NULL::VARCHAR AS id, v::DOUBLE AS value FROM ({s}) AS x(v)" for p, s in (numbers or {}).items()]
    parts += [f"SELECT {q(p)} AS program, id, value FROM numbers WHERE attribute = '{a}' AND id IN ({of})" for p, (a, of) in (values or {}).items()]
    return with_ + "\nUNION ALL ".join(parts)


QUERIES = {
    "funql_sets": _funql(SETS), "funql_extremes": _funql(EXTREMES), "funql_numbers": _funql([*NUMBERS, *VALUES]),
    "dcs_sets": _dcs(DCS_SETS), "dcs_numbers": _dcs(DCS_NUMBERS),
}
ORACLES = {
    "funql_sets": _sql(ATLAS, SETS), "funql_extremes": _sql(ATLAS, EXTREMES), "funql_numbers": _sql(ATLAS, {}, NUMBERS, VALUES),
    "dcs_sets": _sql(BLOCKS, DCS_SETS), "dcs_numbers": _sql(BLOCKS, {}, DCS_NUMBERS),
}

"""The filter language and text search against goldens and a brute-force evaluator."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.plans import predicate, textsearch

CAT, NUM = ColumnMeta("categorical"), ColumnMeta("scalar")


def ids(ds, expr, **kw):
    return sorted(r["i"] for r in ds.filter(expr, **kw).df.select("i").collect())


def make(spark, rows, kind, **meta):
    return Dataset.of(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, a {kind}"), "d", **({"a": CAT} | meta))


@pytest.fixture(scope="module")
def numbers(spark):
    return make(spark, [1, 2, 1, 2, -1], "int")


@pytest.fixture(scope="module")
def words(spark):
    return make(spark, ["adulate", "adulterate", "advocating", "aesthete", "afterword"], "string")


SYNONYMS = {
    (0, 2): ["=", "==", "equal to", "equals", "eq", "equalto"],
    (1, 3): ["greaterthan", "gt", ">", "greater than"],
    (0, 1, 2, 3): ["greaterthanorequalto", "greaterequal", ">=", "=>", "ge", "greater than or equal to", "greater or equal"],
    (4,): ["lessthan", "lt", "<", "less than"],
    (0, 2, 4): ["lessthanorequalto", "lessequal", "<=", "=<", "le", "less than or equal to", "less or equal"],
    (1, 3, 4): ["notequalto", "notequal", "!=", "<>", "doesnotequal", "ne", "!==", "#", "does not equal", "not equal to", "not equal"],
}
PREFIXES = {
    ("ad", (0, 1, 2)): ["=:", "starting with", "==:", "startingwith", "startswith", "eq:"],
    ("ad", (3, 4)): ["notequalto:", "notequal:", "!=:", "<>:", "doesnotequal:", "ne:", "!==:", "#:", "does not equal:", "not equal to:", "not starting with", "notstartingwith"],
    ("adv", (0, 1)): ["lessthan:", "lt:", "<:", "less than:"],
    ("adv", (0, 1, 2)): ["lessthanorequalto:", "lessequal:", "le:", "<=:", "=<:", "less than or equal to:"],
    ("adu", (2, 3, 4)): ["greaterthan:", "gt:", ">:", "greater than:"],
}


def test_synonyms(numbers, words):
    conds = [(numbers, f"a {op} 1", want) for want, ops in SYNONYMS.items() for op in ops]
    conds += [(words, f"a {op} '{p}'", want) for (p, want), ops in PREFIXES.items() for op in ops]
    for ds in (numbers, words):
        mine = [(e, w) for d, e, w in conds if d is ds]
        flags = ds.df.select("i", *[F.coalesce(predicate.to_column(e, ds), F.lit(False)).alias(f"c{k}") for k, (e, _) in enumerate(mine)]).collect()
        for k, (e, want) in enumerate(mine):
            assert tuple(sorted(r["i"] for r in flags if r[f"c{k}"])) == want, e


def test_logic_and_lists(numbers, words):
    assert ids(numbers, "not a=1") == [1, 3, 4] and ids(numbers, "a in (1, -1)") == [0, 2, 4] and ids(numbers, "a notin (1, -1)") == [1, 3]
    assert ids(numbers, "a = 1 or a = 2 and not a = 2") == [0, 2] and ids(numbers, "(a = 1 or a = 2) and not a = 2") == [0, 2]
    assert ids(words, "a in: ('adul*', 'af')") == [0, 1, 4] and ids(words, "a notin: ('adul', 'af')") == [2, 3]
    assert ids(numbers, "a between (1, 2)") == [0, 2]
    assert ids(words, r'a = "ad\x75late"') == [0] and ids(words, r"a = r'adulate'") == [0]


def test_dates(spark):
    days = [dt.date(*x) for x in ((1956, 4, 23), (2003, 9, 30), (2002, 3, 1), (2000, 6, 21), (2009, 5, 27), (3003, 9, 11), (1903, 4, 2), (1803, 9, 9), (1803, 9, 9), (103, 9, 29))]
    ds = make(spark, days, "date", a=ColumnMeta("ordinal"))
    assert ids(ds, "a ge date(1960,1,1)") == ids(ds, "a ge date 1960-1-1") == [1, 2, 3, 4, 5]
    assert ids(ds, "a le date(1903,4,2)") == [6, 7, 8, 9] and ids(ds, "a == date 3003-9-11") == [5] and ids(ds, "a < date(103,9,29)") == []
    assert ids(ds, "a between (date(1850,1,1),date(1950,1,1))") == [6] and ids(ds, "a =: '1803'") == [7, 8]
    now = dt.datetime(2002, 3, 6, 13, 0)  # a Wednesday
    assert ids(ds, "a >= reldate(days=-5)", now=now) == [1, 2, 4, 5] and ids(ds, "a >= reldate(days=-4)", now=now) == [1, 4, 5]
    assert predicate.RelativeDate(days=-7, align="monday").resolve(now) == dt.date(2002, 2, 25)
    assert predicate.RelativeDate(months=-1, align="bom").resolve(now) == dt.date(2002, 2, 1)
    assert predicate.RelativeDate(years=-1, align="boy").resolve(now) == dt.date(2001, 1, 1)
    assert predicate.RelativeDate(months=1).resolve(dt.date(2001, 1, 31)) == dt.date(2001, 2, 28)
    for bad in ("reldate(days=-1, months=-1)", "reldate(poo=1)", 'reldate(align="xxx")'):
        with pytest.raises(predicate.FilterError):
            predicate.parse(f"a >= {bad}")


def test_bad_filters(spark, numbers):
    for bad in ("a", "a ~ 1", "a = ", "a in 1", "a between (1)", "(a = 1", "a = 1 b", "= 1", "a = 1 and"):
        with pytest.raises(predicate.FilterError):
            predicate.parse(bad)
    with pytest.raises(ValueError):
        numbers.filter("zz = 1")
    ds = Dataset.of(numbers.df, "d", a=NUM, i=ColumnMeta("identity"))
    for bad in ("a in (1)", "a =: '1'", "i = 1", "a contains [[x]]"):
        with pytest.raises(predicate.FilterError):
            ds.filter(bad)


def test_builder_round_trip(numbers):
    t = predicate.Term("a")
    node = (t.eq(1) | t.ge(2)) & ~t.in_(5, 6) & ~t.eq_prefix("-")
    assert predicate.parse(node.text()) == node.tree or ids(numbers, node.text()) == [0, 1, 2, 3]
    assert ids(numbers, node.text()) == [0, 1, 2, 3]


def test_multi_valued(spark):
    ds = make(spark, [["x", "y"], ["x"], [], None], "array<string>")
    assert ids(ds, "a = 'x'") == [0, 1] and ids(ds, "a != 'x'") == [0] and ids(ds, "not a = 'x'") == [2, 3] and ids(ds, "a =: 'y'") == [0]


VALUES = st.one_of(st.none(), st.integers(-2, 3))
LEAF = st.tuples(st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(-2, 3)) | st.tuples(st.sampled_from(["in", "notin", "between"]), st.tuples(st.integers(-2, 3), st.integers(-2, 3)))
TREE = st.recursive(st.tuples(st.sampled_from("ab"), LEAF), lambda t: st.tuples(st.just("not"), t) | st.tuples(st.sampled_from(["and", "or"]), t, t), max_leaves=5)


def _brute(tree, row):
    if tree[0] == "not":
        return not _brute(tree[1], row)
    if tree[0] in ("and", "or"):
        x, y = _brute(tree[1], row), _brute(tree[2], row)
        return (x and y) if tree[0] == "and" else (x or y)
    name, (op, v) = tree
    x = row["ab".index(name)]
    if name == "b" and x is None:
        return op in () or False
    key = lambda z: (z is not None, z if z is not None else 0)
    return {
        "=": lambda: x == v, "!=": lambda: x != v, "<": lambda: key(x) < key(v), "<=": lambda: key(x) <= key(v), ">": lambda: key(x) > key(v), ">=": lambda: key(x) >= key(v),
        "in": lambda: x in v, "notin": lambda: x not in v, "between": lambda: x is not None and v[0] <= x < v[1],
    }[op]()


def _text(tree):
    if tree[0] == "not":
        return f"not ({_text(tree[1])})"
    if tree[0] in ("and", "or"):
        return f"({_text(tree[1])}) {tree[0]} ({_text(tree[2])})"
    name, (op, v) = tree
    return f"{name} {op} {v if isinstance(v, int) else '(%d, %d)' % v}"


def _scalar_safe(tree):
    if tree[0] in ("not", "and", "or"):
        return all(map(_scalar_safe, tree[1:]))
    return tree[0] == "a" or tree[1][0] not in ("in", "notin")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREE.filter(_scalar_safe), min_size=4, max_size=4))
def test_against_brute_force(spark, trees):
    rows = [(i, a, b) for i, (a, b) in enumerate((x, y) for x in (None, -2, 0, 1, 3) for y in (None, -1, 2))]
    ds = Dataset.of(spark.createDataFrame(rows, "i int, a int, b int"), "d", a=CAT, b=NUM)
    got = ds.df.select("i", *[F.coalesce(predicate.to_column(_text(t), ds), F.lit(False)).alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for k, t in enumerate(trees):
        assert [r["i"] for r in got if r[f"c{k}"]] == [i for i, a, b in rows if _brute(t, (a, b))], _text(t)


TEXTS = ["The cat bit the dog", "a dog was bitten; the cat's paw", "", None, "dog dog dog cat", "It's the cats' DOG " + "filler " * 12 + "cat", "x"]


@pytest.fixture(scope="module")
def texts(spark):
    return make(spark, TEXTS, "string", a=ColumnMeta("searchabletext"))


@pytest.mark.parametrize(
    ("search", "want"),
    [
        ("cat", [0, 4, 5]), ("CAT dog", [0, 4, 5]), ("cat | paw", [0, 1, 4, 5]), ("dog &- cat", [1]), ("dog - bit", [1, 4, 5]), ("cat's", [1, 5]), ("cat*", [0, 1, 4, 5]), ("*itt*", [1]),
        ("cat < dog", [0]), ("dog < cat", [4]), ("dog <[20] cat", [4, 5]), ("cat ~[1] dog", [4]), ("cat > dog", [4]), ('"the cat"', [0]), ('"the (cat | dog)"', [0]), ('"dog dog cat"', [4]), ("x", []), ("missing", []),
        ("(cat | paw) - filler", [0, 1, 4]), ("cat < bit < dog", [0]),
    ],
)
def test_search(texts, search, want):
    assert ids(texts, f"a contains [[{search}]]") == want
    node = textsearch.parse(search)
    assert ids(texts, f"a contains [[{textsearch.unparse(node)}]]") == want


def test_search_negated_and_bad(texts):
    assert ids(texts, "not a contains [[cat]]") == [1, 2, 3, 6]
    for bad in ("", "(a", '"', "a |", "a & | b"):
        with pytest.raises((textsearch.SearchError, IndexError)):
            textsearch.parse(bad)
    marked = texts.df.where("i = 1").select(textsearch.highlight(textsearch.parse("cats bit*"), F.col("a"), "[", "]")).first()[0]
    assert marked == "a dog was [bitten]; the [cat's] paw"


def test_filters_reach_the_scan(spark, sf):
    ds = Dataset.of(spark.read.parquet(f"{sf}/nhds.parquet"), "nhds", sex=CAT, age=NUM)
    plan = ds.filter("not sex = 1 and age >= 65").df.select("row_ordinal")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(age,65" in plan and "Not(EqualTo(sex,1))" in plan and "ReadSchema: struct<row_ordinal:bigint,sex:int,age:double>" in plan


def test_plurals():
    from tallyframe.functions.labels import pluralise

    for one, many in {"bus": "buses", "trip": "trips", "city": "cities", "day": "days", "axis": "axes", "box": "boxes", "branch": "branches", "wish": "wishes", "ox": "oxs", "": "s"}.items():
        assert pluralise(one) == many

import random

from folioquery.operators import prefix as P

SHORT = ["apple", "application", "apply", "appetite", "banana"]
LONG = ["apple", "application", "apply", "appetite", "banana", "bat", "battle", "cat", "cater", "dog"]


def words(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "ordinal int, word string")


def walk(values, prefix):
    """Words below prefix in the order of a tree of nested dicts."""
    root = {}
    for w in values:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = True
    out = []

    def go(node, sofar):
        if "" in node:
            out.append(sofar)
        for c, child in node.items():
            if c:
                go(child, sofar + c)

    node = root
    for c in prefix:
        if c not in node:
            return []
        node = node[c]
    go(node, prefix)
    return out


def test_tree_order(spark):
    for values in (SHORT, LONG, ["ab", "a", "abc", "b", "ab", "aa", "Ab"]):
        for prefix in ("app", "ba", "", "zzz", "APP", "a"):
            got = [r["word"] for r in P.complete_from_tree(words(spark, values), prefix, 20).orderBy("rank").collect()]
            assert got == walk(values, prefix), (values, prefix)
    assert [r["word"] for r in P.complete_from_tree(words(spark, SHORT), "app").orderBy("rank").collect()] == ["apple", "application", "apply"]


def test_list_order(spark):
    ask = lambda p: [r["word"] for r in P.complete_from_list(words(spark, LONG), p).collect()]
    assert ask("ba") == ["banana", "bat", "battle"] and ask("APP") == ["apple", "application", "apply", "appetite"]
    assert ask("") == LONG[:5] and ask("zzz") == []


def test_a_table_of_prefixes_equals_the_walk_of_each(spark):
    rng = random.Random(3)
    for values in (SHORT + LONG, ["ab", "a", "abc", "b", "ab", "aa", "Ab", "", "a", "ab", "ab", "ab", "ab"], ["".join(rng.choices("abé", k=rng.randint(0, 6))) for _ in range(120)], []):
        table = P.completion_table(words(spark, [*values, None]), 3)
        prefixes = sorted({w[:n] for w in [*values, "zzz", "APP", "Ab"] for n in range(4)})
        asked = spark.createDataFrame([(p, "x") for p in prefixes], "prefix string, tree_of string")
        got = {r.prefix: (r.tree, r.listed) for r in P.complete_many(table, asked).collect()}
        assert got == {p: (walk(values, p)[:3], [w for w in values if w.startswith(p.lower())][:5]) for p in prefixes}

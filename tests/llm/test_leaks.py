import random

from casebook.llm import leaks


def windows(words, span):
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}


def test_automaton_against_windows():
    random.seed(3)
    for _ in range(40):
        items = [(i, " ".join(random.choice("abcd") for _ in range(random.randrange(0, 25)))) for i in range(6)]
        automaton = leaks.SuffixAutomaton(items, 4)
        doc = [random.choice("abcde") for _ in range(80)]
        got: dict = {}
        for i, size, state in automaton.matches(doc):
            for item in automaton.items[state]:
                got.setdefault(item, set()).add(i)
            assert any(" ".join(doc[i - size + 1 : i + 1]) in f"{t}" for _, t in items)
        for item, text in items:
            ends = {i for i in range(3, 80) if tuple(doc[i - 3 : i + 1]) in windows(text.split(), 4)}
            assert got.get(item, set()) == ends


def test_words_in_any_form():
    plain = leaks.words_of("The final fix, of Größe 36.51 is: naïve")
    assert plain == ["the", "final", "fix", "of", "grösse", "36", "51", "is", "naïve"]
    assert leaks.words_of("THE **ﬁnal** f­i​x – of GRÖSSE 36.51 ｉs\n> naïve") == plain
    assert [w for w, _, _ in leaks.word_spans("THE ﬁnal f­ix")] == ["the", "final", "fix"]


def corpus(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = [(1, item), (2, " ".join(f"w{i}" for i in range(10, 25)) + " and more of its own words"), (3, None), (4, ""), (5, "w1 w2 w3"), (6, item)]
    docs = [
        ("a", "before. " + " ".join(f"W{i}" for i in range(5, 20)) + "; after it goes on, much longer than what was cut " + "x " * 20),
        ("b", " ".join(f"w{i}" for i in range(11))),
        ("c", None), ("d", ""), ("e", item), ("e", item),
        ("f", " ".join(f"w{i}" if i != 12 else "other" for i in range(8, 22))),
    ]
    return spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_leaked_items(spark):
    docs, items = corpus(spark)
    for block in (8_000_000, 50):
        got = sorted((r["doc_id"], r["item_id"], r["n_words"]) for r in leaks.leaked_items(docs, items, block_chars=block).collect())
        assert got == [("a", 1, 15), ("a", 6, 15), ("e", 1, 30), ("e", 1, 30), ("e", 2, 15), ("e", 2, 15), ("e", 6, 30), ("e", 6, 30)]
    named = items.selectExpr("concat('item ', item_id) AS item_id", "text")
    assert {r["item_id"] for r in leaks.leaked_items(docs, named).collect()} == {"item 1", "item 2", "item 6"}
    assert leaks.leaked_items(docs.where("false"), items).count() == 0
    assert leaks.leaked_items(docs, items.where("false")).count() == 0


def test_without_leaks(spark):
    docs, items = corpus(spark)
    rows = {r["doc_id"]: r for r in leaks.without_leaks(docs, items).collect()}
    assert rows["a"]["text"].startswith("before. ; after it") and rows["a"]["n_removed"] == 15 and rows["a"]["kept"]
    assert rows["e"]["text"] is None and not rows["e"]["kept"]
    assert rows["b"]["n_removed"] == 0 and rows["c"]["text"] is None and rows["c"]["kept"]


def test_blocks_of_items_make_no_difference(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(15)) for c in "pq")
    items = spark.createDataFrame([(1, first), (2, second), (3, "s0 s1 s2 s3 s4 s5 t0 t1 t2 t3 t4 t5 t6")], "item_id long, text string")
    docs = {
        "half by both": f"{first} {'x ' * 10} {second} {'y ' * 10}",
        "third by one": f"{first} {'x ' * 30}",
        "joined by a cut": f"{'x ' * 30} s0 s1 s2 s3 s4 s5 {first} t0 t1 t2 t3 t4 t5 t6 {'y ' * 30}",
        "none": "plain words",
    }
    frame = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    found = [sorted(tuple(r) for r in leaks.without_leaks(frame, items, block_chars=n).collect()) for n in (8_000_000, 50, 1)]
    assert found[0] == found[1] == found[2]
    assert {d: (n, kept) for d, _, n, kept in found[0]} == {"half by both": (30, False), "third by one": (15, True), "joined by a cut": (15, True), "none": (0, True)}


def test_an_automaton_is_built_once_a_worker():
    class Shared:
        value = [(1, "a b c d e")]

    first = leaks._automaton("one", Shared, 3)
    assert leaks._automaton("one", Shared, 3) is first
    assert leaks._automaton("two", Shared, 3) is not first and len(leaks._built) == 1

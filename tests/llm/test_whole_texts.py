"""Texts of any length and words outside leaked stretches: nothing is cut."""

from lodestrata.llm import leakage, subjects


def test_passages_from_the_end_of_a_very_long_item():
    item = [f"w{i}x" for i in range(70_000)]
    index = leakage.ItemIndex([(1, " ".join(item))], 10, 0.25)
    for at in (0, 65_530, 65_540, len(item) - 10):
        assert index.search("int x; // " + " ".join(item[at : at + 10])) == [(1, "passage")], at
    assert not index.search(" ".join(item[-9:]))


def test_words_of_items_count_outside_leaked_stretches(spark):
    item = "Dough in the oven will rise if yeast and whisk were used before the court met its judge at noon"
    index = leakage.ItemIndex([(1, item)], 10, 0.25)
    own = "oven_dough(yeast, whisk); İ "
    assert index.without(own) == own and index.without(None) is None
    for leaked in (item, item.upper().replace(" ", "\\n * "), item.replace("oven", "pan").replace("rise", "fall")):
        kept = index.without(own + leaked + ". " + own + leaked + " " + own)
        assert leakage.words(kept) == leakage.words(own) * 3, kept
    passage = " ".join(item.split()[3:14])
    assert leakage.words(index.without(f"yeast {passage} plea")) == ["yeast", "plea"]
    rows = [(i, "dough oven whisk yeast" if i % 2 == 0 else "court judge plea verdict") for i in range(40)] + [(50, "oven_dough whisk yeast"), (51, "plea verdict court // " + item)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "cook" if i % 2 == 0 else "law") for i in range(12)], "doc_id long, subject string")
    areas = spark.createDataFrame([("cook",), ("law",)], "subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(documents, labels, areas, foreign=spark.createDataFrame([(item,)], "item_text string")).collect()}
    assert got == {(i, "cook" if i % 2 == 0 else "law") for i in range(40)} | {(50, "cook"), (51, "law")}

"""The text problems over whole given tables against brute force or held-out labels, and odd cases."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import leakage, mixing, queries, subjects


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def plain_words(text):
    text = re.sub(r"\\(u[0-9a-f]{4}|x[0-9a-f]{2}|[nrtfvb0])", " ", (text or "").lower())
    return re.findall(r"[^\W_]+", text)


def holds(document, item, run=10):
    """By the definition: a run of words, or the whole item with at most a quarter edited (plain dynamic programming)."""
    if any(tuple(item[i : i + run]) == tuple(document[j : j + run]) for i in range(len(item) - run + 1) for j in range(len(document) - run + 1)):
        return True
    column = list(range(len(item) + 1))
    best = column[-1]
    for word in document:
        new = [0]
        for j, mine in enumerate(item, 1):
            new.append(min(column[j - 1] + (mine != word), column[j] + 1, new[j - 1] + 1))
        column, best = new, min(best, new[-1])
    return best <= len(item) // 4


def test_p8_found_against_brute_force(spark, sf_dir):
    got = {tuple(r) for r in queries.p8_found(spark, sf_dir).select("doc_id", "item_id").collect()}
    items = [(i["item_id"], plain_words(i["item_text"])) for i in read(sf_dir, "eval_items")]
    want = set()
    for d in read(sf_dir, "documents"):
        words = plain_words(d["text"])
        there = set(words)
        # Either kind of match has ten words of the item, or all but a quarter.
        want |= {(d["doc_id"], n) for n, item in items if sum(w in there for w in item) >= min(10, len(item) - len(item) // 4) and holds(words, item)}
    assert got == want and got


ITEM = "Whenever eleven bells touch each lamplighter stacks both and folds some ribbons beneath the stairs while no ferryman sorts such buttons again today"


@pytest.mark.parametrize("seed", range(6))
def test_any_quarter_may_be_altered_or_lost(seed):
    rng, item = random.Random(seed), plain_words(ITEM)
    for n in (4, 5, 6, 7, 8, 9, 10, 11, 13, 17, len(item)):
        part = item[:n]
        index = leakage.ItemIndex([(1, " ".join(part))], 10, 0.25)
        chosen = rng.sample(range(n), n // 4)
        changed = [w if i not in chosen else rng.choice(["", "zzz"]) for i, w in enumerate(part)]
        assert index.search("int x; /* " + " \\n_ ".join(changed) + " */ return x;"), (n, changed)
    for _ in range(20):
        at = rng.randrange(len(item) - 9)
        assert leakage.ItemIndex([(1, ITEM)], 10, 0.25).search("a b // " + "\n// ".join(item[at : at + 10]).upper() + "."), at
        assert not leakage.ItemIndex([(1, ITEM)], 10, 0.25).search(" ".join(item[at : at + 9]))


def test_leaks_odd_cases(spark):
    long_text = "filler word " * 200_000 + ITEM
    documents = spark.createDataFrame(
        [(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "", 5), (4, long_text, 5), (5, "go now", 5), (6, "?!", 5)], "doc_id long, text string, item_id int"
    )
    items = spark.createDataFrame([(10, ITEM, 0), (11, "", 0), (12, None, 0), (13, "Go, now!", 0), (14, "stairs", 0), (15, "--", 0)], "item_id long, item_text string, doc_id int")
    for block in (1 << 20, 8):
        got = sorted(tuple(r)[:2] for r in leakage.leaks(documents, items, block_bytes=block).collect())
        assert got == [(1, 10), (1, 14), (4, 10), (4, 14), (5, 13)]
    assert leakage.leaks(documents.limit(0), items).count() == 0 and leakage.leaks(documents, items.limit(0)).count() == 0


def test_reparameterised_questions_need_consistent_slots():
    item = "Alice has 3 apples and 5 km to walk with 3 friends and 8 dogs over 12 days so how far does Alice go"
    index = leakage.ItemIndex([(1, item)], 10, 0.25)
    other = item.replace("Alice", "Bob").replace("km", "miles").replace("12", "30").replace("8", "9").replace("3 ", "7 ").replace("5", "6")
    assert index.search(other) == [(1, "reparameterised")]
    assert index.search(other.replace("7 friends", "8 friends")) == []
    quantities = "Then Ada pours 10km of 1e5 rope over 300 kelvin while the kettle of Ada sings for 2x nights"
    asked = leakage.ItemIndex([(1, quantities)], 10, 0.25)
    said = "then Zelda pours 12km of 2e7 rope over 450 kilometres while the kettle of Zelda sings for 9x nights"
    assert asked.search(said) in ([(1, "reparameterised")], [(1, "whole")])
    assert leakage.ItemIndex([(1, quantities)], 10, 0.1).search(said) == [(1, "reparameterised")]
    assert leakage.ItemIndex([(1, quantities)], 10, 0.1).search(said.replace("of Zelda", "of Boris")) == []
    assert leakage.window_length(40, 0.25) == 3 and leakage.window_length(8, 0.25) == 2 and leakage.window_length(1, 0.25) == 1


def test_p9_budgets_and_shares(spark, sf_dir):
    mix, shares = queries.p9_mix(spark, sf_dir).toPandas(), queries.p9_shares(spark, sf_dir).toPandas()
    documents = {d["doc_id"]: d for d in read(sf_dir, "documents")}
    assert not mix.duplicated(["mix_name", "doc_id"]).any() and (mix.copies > 0).all()
    assert all(documents[r.doc_id]["source"] == r.source for r in mix.itertuples())
    for t in read(sf_dir, "mix_targets"):
        mine = mix[(mix.mix_name == t["mix_name"]) & (mix.source == t["source"])]
        row = shares[(shares.mix_name == t["mix_name"]) & (shares.source == t["source"])].iloc[0]
        assert (mine.copies <= t["max_repeats"]).all() and (mine.tokens * mine.copies).sum() == row.actual_tokens
        largest = mine.tokens.max() if len(mine) else 0
        assert abs(row.actual_tokens - row.budget_tokens) <= largest and (mine.copies.max() - mine.copies.min() <= 1 if len(mine) else True)
    assert np.allclose(shares.groupby("mix_name").actual_share.sum(), 1) and np.allclose(shares.groupby("mix_name").target_share.sum(), 1)


def test_counts_and_prefix_sums_against_brute_force(spark):
    documents = spark.createDataFrame([(i, f"word {'tok ' * (i % 7)}", "s" if i % 3 else None, 0) for i in range(300)] + [(900, None, "s", 0), (901, "", "s", 0)], "doc_id long, text string, source string, tokens int")
    counts = mixing.token_counts(documents)
    assert {r.doc_id: r.tokens for r in counts.collect()}[900] == 0
    for buckets in (1, 16, 4096):
        placed = mixing.placed(counts, 3, buckets).where("source IS NOT NULL").toPandas().sort_values(["before", "tokens"])
        assert (placed.before + placed.tokens).max() == placed.tokens.sum()
        real = placed[placed.tokens > 0]
        assert (real.before.to_numpy()[1:] == (real.before + real.tokens).to_numpy()[:-1]).all()


def test_mixing_odd_cases(spark):
    documents = spark.createDataFrame([(1, "a b c", "s"), (2, "a b c", "s"), (3, "x y z", "t"), (4, "q", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame(
        [("m", "s", 1.0, 1, 4.0), ("m", "t", 1.0, 9, 4.0), ("m", "none", 1.0, 3, 4.0), ("z", "s", 0.0, 1, 1.0), ("z", "t", None, None, None)],
        "mix_name string, source string, target_weight double, max_repeats int, size_ratio double",
    )
    got = {(r.mix_name, r.source): r for r in mixing.shares(documents, targets).collect()}
    assert got["m", "s"].n_copies == 2 and got["m", "s"].most_repeats == 1 and got["m", "none"].actual_tokens == 0
    assert got["z", "s"].actual_tokens == got["z", "t"].actual_tokens == 0
    filled = {r.source: r for r in mixing.shares(documents, targets.where("mix_name = 'm'"), refill=True).collect()}
    assert filled["t"].n_copies == 9 and filled["t"].n_copies > got["m", "t"].n_copies
    assert mixing.shares(documents.limit(0), targets).where("actual_tokens > 0").count() == 0
    assert mixing.shares(documents, targets.limit(0)).count() == 0


def test_p10_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents, labels, areas = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "doc_labels", "subject_areas"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = subjects.subject_areas(documents, labels.where(~held_out), areas)
    got = {(r.doc_id, r.subject) for r in found.collect()}
    assert all(0.5 <= r.posterior <= 1 for r in found.limit(100).collect())
    ids = {r.doc_id for r in labels.where(held_out).collect()}
    said = {(r.doc_id, r.subject) for r in labels.where(held_out).collect()}
    right = len({g for g in got if g[0] in ids} & said)
    # A few of the labels are wrong or missing, so neither can reach 1.
    assert right / len(said) > 0.9 and right / len({g for g in got if g[0] in ids}) > 0.85
    per_doc = {}
    for d, s in got:
        per_doc.setdefault(d, set()).add(s)
    assert max(map(len, per_doc.values())) == 2 and len(per_doc) > 0.95 * documents.count()


def test_subjects_odd_cases(spark):
    a, b = "dough oven whisk yeast bake", "court judge plea verdict bail"
    rows = [(i, f"def {w}_{i % 3}(x): # {w}", 0) for i, w in enumerate([a.replace(" ", "_"), b.replace(" ", "_")] * 20)]
    rows += [(100, None, 0), (101, "", 0), (102, "{}", 0), (103, (a + " ") * 100_000, 0), (0, rows[0][1], 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, subject int")
    labels = spark.createDataFrame([(i, "cook" if i % 2 == 0 else "law", 1) for i in range(12)] + [(5, "unknown", 1), (7777, "law", 1), (None, "law", 1)], "doc_id long, subject string, slots int")
    areas = spark.createDataFrame([("cook", ""), ("law", ""), (None, "")], "subject string, about string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(documents, labels, areas).collect()}
    assert got == {(i, "cook" if i % 2 == 0 else "law") for i in range(40)} | {(103, "cook")}
    assert subjects.subject_areas(documents, labels.limit(0), areas).count() == 0
    assert subjects.subject_areas(documents.limit(0), labels, areas).count() == 0
    assert subjects.subject_areas(documents, labels, areas.limit(0)).count() == 0


def test_words_of_leaked_items_are_not_the_documents_own(spark):
    rows = [(i, "dough oven whisk yeast" if i % 2 == 0 else "court judge plea verdict") for i in range(40)] + [(50, "dough oven whisk yeast kites ropes bells"), (51, "kites ropes bells")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "cook" if i % 2 == 0 else "law") for i in range(12)] + [(51, "law")], "doc_id long, subject string")
    areas = spark.createDataFrame([("cook",), ("law",)], "subject string")
    items = spark.createDataFrame([("Kites, ropes and bells.",), (None,)], "item_text string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(documents, labels, areas, foreign=items).where("doc_id >= 50").collect()}
    assert got == {(50, "cook")}


def test_any_number_of_words_and_names_in_any_case(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(3_000_000)}q" for _ in range(40))) for i in range(2000)]
    items.append((9999, "When Marlow met Quentin they spoke of harbours and lights until the tide turned"))
    index = leakage.ItemIndex(items, 10, 0.25)
    for i in (0, 1000, 1999):
        assert index.search("x = 1; # " + " ".join(items[i][1].split()[15:25])) == [(i, "passage")]
    # Numbers beyond the cube root of 64 bits wrap in a window's key; they still find what they should.
    index.number = {w: n + (1 << 45) for w, n in index.number.items()}
    assert index.keys(index.numbers_of(items[0][1].split()), 3)[1].all()
    for text in (items[-1][1].lower(), items[-1][1].upper()):
        assert leakage.ItemIndex(items[-1:], 10, 0.25).search(text) == [(9999, "passage")]


def test_words_of_any_script_count():
    slots = subjects._Slots()
    for text, n in (("école Élève_naïve", 3), ("хлеб печьХлеб", 2), ("面包 烤箱", 2), ("λόγος", 1), ("ab é x9", 0), ("snake_caseWord HTTPServer", 5)):
        assert len(subjects.slot_counts(text, slots)[0]) == n, text


def test_refill_against_filling_step_by_step(spark):
    rng = random.Random(5)
    counts = spark.createDataFrame([(i, f"s{i}", rng.randrange(1, 50)) for i in range(40)], "doc_id int, source string, tokens long")
    rows = [("m", f"s{i}", rng.choice([0.0, rng.random()]), rng.randrange(0, 5), 1.5) for i in range(45)]
    plan = mixing.budgets(counts, spark.createDataFrame(rows, "mix_name string, source string, target_weight double, max_repeats int, size_ratio double"), refill=True).toPandas()
    budget = np.zeros(len(plan))
    for _ in range(200):
        room = np.where(budget < plan.cap - 1e-9, plan.target_share, 0)
        if room.sum() == 0:
            break
        budget = np.minimum(budget + (plan.wanted.max() - budget.sum()) * room / room.sum(), plan.cap)
    assert np.allclose(plan.budget, budget) and abs(plan.budget.sum() - min(plan.wanted.max(), plan.cap[plan.target_share > 0].sum())) < 1e-6


@pytest.mark.parametrize("anywhere", [True, False])
def test_edits_against_the_plain_table(anywhere):
    rng = random.Random(3)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (9, 14))
        column, want = list(range(len(item) + 1)), []
        for end, word in enumerate(text, 1):
            new = [0 if anywhere else end]
            for j, mine in enumerate(item, 1):
                new.append(min(column[j - 1] + (mine != word), column[j] + 1, new[j - 1] + 1))
            column = new
            want.append(column[-1])
        assert leakage.edits_by_end(np.array(item), np.array(text), anywhere).tolist() == want
        edits = rng.randrange(len(item))
        assert min(want) > edits or leakage.may_hold(np.array(item), np.array(text), edits) or not anywhere

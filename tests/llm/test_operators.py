"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import collections
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapoint.llm import ann, decontaminate, near_dup, packing, quality, shards, site_tree, substring_dedup, toxicity, url_reputation
from terrapoint.llm import queries as registered
from terrapoint.llm.common import IdFilter, without_ids

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start string, maybe_id string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts):
    """Documents with two more columns whose names clash with ones that operators use."""
    return spark.createDataFrame([(i, t, "s", "m") for i, t in texts], DOCS)


ODD = [(900, None), (901, ""), (902, " \n "), (903, "x" * 200_000), (904, "one two"), (904, "one two"), (None, "no id here")]


# Packing.


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [(i, words(rng, rng.choice([1, 40, 500, 3000]))) for i in range(60)] + ODD[:-1] + [(905, "déjà  vu \x1c <|endoftext|> 日本 ４\n\n")]
    rows = packing.pack(docs(spark, texts), registered.tokenizer_path(), 1024).collect()
    plain = Tokenizer.from_file(registered.tokenizer_path())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in dict(texts).items():
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(pieces[i], key=lambda r: r["start"])
        copies = sum(j == i for j, _ in texts)
        assert all(r["doc_tokens"] == len(want) for r in got)
        assert sum(r["length"] for r in got) == copies * len(want)
        for r in got:
            assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want[r["start"] : r["start"] + r["length"]]
    short = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        short += sum(p["length"] for p in parts) < 1024
        assert sum(p["length"] for p in parts) <= 1024
    assert short <= docs(spark, texts).rdd.getNumPartitions()
    assert packing.pack(docs(spark, []), registered.tokenizer_path()).count() == 0


def test_level_rule_is_the_sum_of_squares():
    rng = random.Random(3)
    packer = packing.LevelPacker(20)
    for _ in range(500):
        size = rng.randrange(1, 20)
        scores = {}
        for level in range(0, 21 - size):
            if level and not packer.counts[level]:
                continue
            after = packer.counts.copy()
            after[level] -= bool(level)
            after[level + size] += level + size < 20
            scores[level] = int((after[:20] ** 2).sum())
        assert scores[packer.level_for(size)] == min(scores.values())
        packer.place((0, 0, size, b"\0\0\0\0" * size), size)
        assert [len(x) for x in packer.open] == packer.counts.tolist()


# Near duplicates.


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {i: words(rng, rng.randrange(30, 300)) for i in range(60)}
    for i in range(60, 110):
        base = texts[rng.randrange(60)]
        texts[i] = edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 40))
    family = words(rng, 200)
    texts |= {i: edited(rng, family, 2) for i in range(200, 260)}
    with np.errstate(over="ignore"):
        made = {i: near_dup.shingles(near_dup.word_hashes(t), 5) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(set(made[a].tolist()) & set(made[b].tolist())) and near_dup.aligned_similarity(made[a], made[b], 0.8) >= 0.8:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    rows = list(texts.items()) + ODD
    got = near_dup.classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in got}
    for i in texts:
        assert classes[i] == root(i)
    assert all(classes[i] == i for i in (900, 901, 902, 903, 904)) and classes[None] is None
    assert near_dup.classes(docs(spark, [])).count() == 0


def test_large_families_lose_no_link(spark):
    rng = random.Random(11)
    base = words(rng, 150)
    texts = {i: edited(rng, base, rng.randrange(1, 14)) for i in range(140)}
    for i in range(140, 200):
        texts[i] = edited(rng, texts[rng.randrange(140)], rng.randrange(1, 4))
    with np.errstate(over="ignore"):
        made = {i: near_dup.shingles(near_dup.word_hashes(t), 5) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and near_dup.aligned_similarity(made[a], made[b], 0.8) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs(spark, list(texts.items())), block_bytes=20_000).collect()}
    assert links and not [p for p in links if got[p[0]] != got[p[1]]]
    assert len(set(got.values())) > 1 and len(got) == 200


def test_every_pair_that_shares_a_sketch_is_settled(spark):
    """A family around one text, most of it under the similarity to it: no class may lose a link between candidates."""
    rng = random.Random(12)
    base, texts = words(rng, 120), {}
    for i in range(2000):
        texts[i] = edited(rng, base, rng.randrange(2, 7)) if i % 10 else edited(rng, texts.get(i - 7, base), 1)
    seeds = np.random.default_rng(7).integers(1, 2**63, size=16, dtype=np.uint64)
    with np.errstate(over="ignore"):
        made = {i: near_dup.shingles(near_dup.word_hashes(t), 5) for i, t in texts.items()}
        held = np.stack([near_dup.sketches(x, seeds, 3) for x in made.values()])
        maps = np.stack([near_dup.parity(x) for x in made.values()])
    want = []
    for a in texts:
        near = np.nonzero((held[a] == held[a + 1 :]).any(axis=1) & (np.bitwise_count(maps[a] ^ maps[a + 1 :]).sum(axis=1) <= 40))[0] + a + 1
        want += [(a, int(b)) for b in near if near_dup.aligned_similarity(made[a], made[int(b)], 0.8) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs(spark, list(texts.items())), block_bytes=200_000).collect()}
    assert len(want) > 1000 and not [p for p in want if got[p[0]] != got[p[1]]]
    for a, b in want[:300]:
        assert len(np.setxor1d(made[a], made[b])) >= np.bitwise_count(maps[a] ^ maps[b]).sum()


def test_copies_up_to_the_threshold_are_found(spark):
    """Recall by changed words of 200-word texts: one changed word costs five shingles, so four are within 0.8."""
    rng, texts = random.Random(15), {}
    for i in range(400):
        texts[i] = words(rng, 200)
        texts[1000 + i] = edited(rng, texts[i], 1 + i % 4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs(spark, list(texts.items()))).collect()}
    assert sum(got[1000 + i] == i for i in range(400)) >= 396


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(16)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (5, c), (None, c), (None, a + " x"), (6, ""), (6, ""), (None, None)]
    assert {(r["doc_id"], r["class_id"]) for r in near_dup.classes(docs(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (None, 1), (6, 6), (None, None)}
    kept = near_dup.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (4, c), (6, ""), (6, ""), (None, None)]))
    assert near_dup.one_of_each(docs(spark, [])).count() == 0


def test_alignment_is_sensitive_to_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.aligned_similarity(a, a, 0.8) == 1.0
    assert near_dup.aligned_similarity(a, np.roll(a, 50), 0.8) == 0.0
    assert near_dup.aligned_similarity(a, a[5:], 0.8) == 0.95
    assert near_dup.aligned_similarity(a, a[:0], 0.8) == 0.0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 8), (8, 9), (11, 11)], "a long, b long")
    got = {r["id"]: r["root"] for r in near_dup.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4}


# Repeated passages.


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(4)
    text = words(rng, 2000) + " ünïcödé " + "漢字" * 500
    ends, digests, counts = substring_dedup.chunked(text)
    assert ends[-1] == len(text.encode()) and sum(counts) == len(text.split()) and max(np.diff([0, *ends])) <= 1024
    moved = substring_dedup.chunked("inserted at the front " + text)[1]
    assert len(set(digests) & set(moved)) >= 0.97 * len(set(digests))
    h = substring_dedup.gear(np.frombuffer(text.encode(), dtype=np.uint8))
    slow = 0
    for i, b in enumerate(text.encode()[:300]):
        slow = (slow * 4 + int(substring_dedup._GEAR[b])) % 2**32
        if i >= 16:
            assert h[i] == (slow & 0xFFFFFFFF)


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(5)
    passage = words(rng, 80)
    texts = [(i, words(rng, 200) + (f" {passage} " if i in (3, 7, 9) else " ") + words(rng, 150)) for i in range(12)]
    texts += [(20, "short line here"), (21, "short line here"), (22, f"{passage} {passage}")]
    df = docs(spark, texts + ODD)
    found = substring_dedup.spans(df).collect()
    assert {r["doc_id"] for r in found} == {7, 9, 22} and {r["first_doc_id"] for r in found} == {3}
    whole = dict(texts)
    for r in found:
        assert len(set(whole[r["doc_id"]].encode()[r["start"] : r["stop"]].decode().split()) & set(passage.split())) >= 50
    kept = {r["doc_id"]: r for r in substring_dedup.cut(df).collect()}
    assert set(kept) == {i for i, _ in texts + ODD} and kept[3]["text"] == whole[3] and kept[903]["start"] == "s"
    assert passage not in kept[9]["text"] and kept[9]["text"].split()[:190] == whole[9].split()[:190]
    assert substring_dedup.cut(docs(spark, [])).count() == 0


def test_texts_that_share_an_id_keep_their_own_spans(spark):
    rng = random.Random(19)
    passage, unique = words(rng, 80), words(rng, 300)
    df = docs(spark, [(1, f"{words(rng, 50)} {passage}"), (2, f"{passage} {words(rng, 30)}"), (2, unique), (2, unique)])
    kept = substring_dedup.cut(df).collect()
    assert sorted(len(r["text"].split()) >= 300 for r in kept if r["doc_id"] == 2) == [False, True, True]
    assert [r["text"] for r in kept].count(unique) == 2 and all(passage not in r["text"] for r in kept if r["doc_id"] == 2)
    assert len(substring_dedup.spans(df).collect()) == 1


def test_passages_just_over_fifty_words_are_never_lost(spark):
    rng = random.Random(13)
    plain, line, han = [words(rng, 51) for _ in range(120)], [" ".join([words(rng, 2)] * 40) for _ in range(30)], ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60)) for _ in range(30)]
    blob = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3000)) for _ in range(5)]
    passages = plain + line + han + blob
    texts = [(i + 1000 * k, f"{words(rng, 60)} {p} {words(rng, 60)}") for k in range(2) for i, p in enumerate(passages)]
    found = substring_dedup.spans(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in found} == {1000 + i for i in range(len(passages))}
    assert substring_dedup.smallest(np.zeros(100, dtype=np.uint32), 10).size <= 12
    assert len(substring_dedup.chunked("x" * 5000)[0]) <= 5000 // 24 + 1


# Benchmark passages.


def test_templates_and_slots(spark):
    item = "so Ann has 3 apples and Bob buys 12 kg of sugar for the cake that Ann will bake on day 12"
    same = "so it is. so Eve has 5 apples and Dan buys 7 lb of sugar for the cake that Eve will bake on day 7 or so"
    torn = "so it is. so Eve has 5 apples and Dan buys 7 lb of sugar for the cake that Joe will bake on day 9 or so"
    benchmark = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (None, "x"), (1, item)], "item_id long, text string")
    texts = [(1, same), (2, torn), (3, item), (4, "nothing of the kind, but two words here"), (5, item[:30]), *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs(spark, texts), benchmark).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2)}
    kept = decontaminate.drop_leaked(docs(spark, texts), benchmark)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in [(5, 0), *ODD]) and kept.columns == docs(spark, []).columns
    assert decontaminate.matches(docs(spark, []), benchmark).count() == 0
    assert decontaminate.matches(docs(spark, texts), benchmark.limit(0)).count() == 0


def test_one_changed_number_does_not_hide_a_copy(spark):
    rng = random.Random(14)
    item = f"{words(rng, 60).replace('w', 'x')} then 12 birds and 5 cats " + " ".join(rng.choices(["came", "went", "sat", "ran", "slept"], k=40))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, f"so {item.replace(' 12 birds', ' 5 birds')} again")]
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs(spark, texts), benchmark).collect()] == [(1, 1)]


def test_renamed_questions_are_found(spark):
    """Names at sentence starts and names of two words, too; a contradiction leaves the longest consistent stretch."""
    item = "Tom has 5 apples. Tom gives 2 to Mary Ann. Mary Ann eats 1 of them. How many apples are left in the end?"
    text = "Well: Sam has 7 apples. Sam gives 3 to Anna. Anna eats 4 of them. How many apples are left in the end? Yes."
    mixed = text.replace("Anna eats", "Sam eats")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.matches(docs(spark, [(1, text), (2, mixed), (3, "Sam has 7 apples")]), benchmark).collect()}
    assert set(got) == {1, 2} and got[1]["tokens"] == got[1]["item_tokens"] == 22 and got[1]["slots"] == 7
    assert got[2]["tokens"] == 13 and got[2]["start"] == 10


def test_stretches_equal_brute_force(spark):
    """Items whose slots were changed, some of them inconsistently, and partly copied ones."""
    rng, items, texts = random.Random(18), {}, {}
    number = re.compile("[0-9]")
    for i in range(40):
        items[i] = " ".join(str(rng.randrange(1, 6)) if rng.random() < 0.2 else rng.choice(["came", "went", "sat", "ran", "slept", f"x{'abcdefgh'[rng.randrange(8)]}"]) for _ in range(40))
        new = {str(a): str(b) for a, b in zip(range(1, 6), rng.sample(range(10, 90), 5), strict=True)}
        copied = [new[t] if number.match(t) else t for t in items[i].split()]
        for _ in range(rng.randrange(3)):
            at = rng.choice([k for k, t in enumerate(copied) if number.match(t)])
            copied[at] = str(rng.randrange(10, 90))
        low = rng.randrange(20)
        texts[i] = " ".join(["then", *copied[low : low + rng.randrange(10, 41)], "and so on"])
    want = {}
    for i in items:
        a, b = items[i].split(), texts[i].split()
        for shift in range(-len(a), len(b)):
            best = 0
            run = [k for k in range(len(a)) if 0 <= k + shift < len(b) and (a[k] == b[k + shift] if not number.match(a[k]) else number.match(b[k + shift]))]
            for k in run:
                there, back, n = {}, {}, 0
                while k + n in run:
                    x, y = a[k + n], b[k + n + shift]
                    if number.match(x) and (there.setdefault(x, y) != y or back.setdefault(y, x) != x):
                        break
                    n += 1
                best = max(best, n)
            want[i] = max(want.get(i, 0), best)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in decontaminate.matches(docs(spark, list(texts.items())), benchmark).collect() if r["doc_id"] == r["item_id"]}
    assert got == {i: n for i, n in want.items() if n >= 13} and 5 < len(got) < 40


def test_items_dense_in_slots_are_found(spark):
    sums = "12 + 34 - 56 = 78, 90 + 21 - 43 = 65, 87 + 19 - 28 = 37, 46 + 55 - 64 = 73"
    mixed = "we then add up the cost of 12 kg 34 lb 56 oz 78 and see how much is left"
    benchmark = spark.createDataFrame([(1, sums), (2, mixed)], "item_id long, text string")
    texts = [(1, f"see {sums} here"), (2, f"see {mixed} here"), (3, sums.replace("1", "7")), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18")]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs(spark, texts), benchmark).collect()} == {(1, 1), (2, 2)}


def test_rows_of_names_and_numbers_have_no_bound(spark):
    """Long rows of capitalised words and of numbers with commas are one token each, and passages beside them are found."""
    item = " ".join(f"x{c}" for c in "abcdefghijklmnop")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, f"{'Anna Bert ' * 100_000}{item}"), (2, f"{'1,2,' * 200_000}3 {item}"), (3, "Anna Bert " * 100_000)]
    got = {r["doc_id"]: (r["start"], r["tokens"]) for r in decontaminate.matches(docs(spark, texts), benchmark).collect()}
    assert got == {1: (1, 16), 2: (1, 16)}


def test_whole_items_are_found_like_brute_force(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    token = lambda t: f" {' '.join(re.findall(r'[^\W\d_]+', t.lower()))} "
    texts = [(r["doc_id"], token(r["text"])) for r in d.collect()]
    want = {(i, r["item_id"]) for r in b.collect() for i, t in texts if token(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in registered.op10_decontamination(spark, SF).collect()}
    assert want and want <= got and len(got - want) <= len(want) // 10


# Classifiers.


def held_out(spark, name, label, d="/root/testdata/sf0.1"):
    rows = registered.QUERIES[name](spark, d)
    joined = rows.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").toPandas()
    assert ((joined["score"] >= 0.3).astype(int) == joined["predicted"]).all() and joined["score"].between(0, 1).all()
    return (joined["predicted"] == joined[label]).mean()


def test_quality_on_held_out_documents(spark):
    assert held_out(spark, "op1_quality", "quality") >= 0.98


def test_toxicity_on_held_out_documents(spark):
    assert held_out(spark, "op5_toxicity", "toxic") >= 0.96


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_odd_rows(spark, module, label):
    rng = random.Random(6)
    texts = [(i, words(rng, 30) + ("\nBUY!! NOW!! BUY!!" * 5 if i % 3 == 0 else "\nmore plain words.")) for i in range(60)]
    df = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)] + [(1, 0, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(df, labels, F.lit(True))
    rows = module.score(df, model).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    good, bad = [by[i] for i in range(60) if i % 3], [by[i] for i in range(60) if i % 3 == 0]
    assert (min(good) > max(bad)) if label == "quality" else (max(good) < min(bad))
    for some in (labels.where(f"{label} = 1"), labels.limit(0)):
        constant = module.fit(df, some, F.lit(True))
        assert {r["score"] for r in module.score(df, constant).collect()} == {constant}
    assert module.score(docs(spark, []), model).count() == 0


def test_field_matches_enumeration():
    rng = np.random.default_rng(0)
    field = quality.Field(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    field.w, field.move = rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2))
    sizes = np.array([4, 1, 3])
    x = rng.normal(size=(8, quality.WIDTH))
    got, at = field.marginals(x, sizes), 0
    for n in sizes:
        e = x[at : at + n] @ field.w
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(field.move[y[i - 1], y[i]] for i in range(1, n)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_counterfactual_penalty_protects_neutral_mentions():
    rng = random.Random(7)
    names, number = ["muslim", "jewish", "scum", "lunch"], {}
    number = {n: i for i, n in enumerate(names)}
    rows, y = [], []
    for i in range(400):
        toxic = i % 2
        found = {"scum"} if toxic and rng.random() < 0.7 else {"lunch"} if rng.random() < 0.5 else set()
        if toxic and rng.random() < 0.8:
            found.add("muslim")
        rows.append([float(n in found) for n in names])
        y.append(toxic)
    change = np.zeros((50, 4), dtype=np.float32)
    change[:, number["muslim"]], change[:, number["jewish"]] = -1, 1
    x = np.array(rows, dtype=np.float32)
    change = change.T @ change / len(change)
    free, _ = toxicity.solve(x, np.array(y), np.ones(400), 0 * change, 10.0)
    fair, _ = toxicity.solve(x, np.array(y), np.ones(400), change, 10.0)
    gap = lambda w: abs(w[0] - w[1])
    assert gap(fair) < 0.2 * gap(free)
    assert toxicity.swapped("A Muslim came. Nobody else!", [("muslim", "jewish")]) == [("a muslim came", "a jewish came")]


def test_counterfactual_penalty_through_fit(spark):
    """A word of one group stands in most toxic texts: with the penalty a swap moves the score less, and neutral
    mentions of the group stay under the threshold."""
    rng, rows, labels = random.Random(17), [], []
    for i in range(600):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.8 if toxic else 0.1) else "jewish" if rng.random() < (0.5 if toxic else 0.89) else ""
        insult = "scumbag" if toxic and rng.random() < 0.9 else ""
        rows.append((i, f"{words(rng, 12, 60)} {group} {insult} {words(rng, 6, 60)}. {words(rng, 8, 60)}"))
        labels.append((i, 1, toxic))
    df, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    free, fair = (toxicity.fit(df, marks, F.lit(True), fairness=f) for f in (0.0, 10.0))
    assert fair.pairs == free.pairs > 200 and fair.change < 0.3 * free.change
    neutral = [f"{words(rng, 20, 60)} muslim {words(rng, 5, 60)}" for _ in range(50)]
    assert sum(fair.logit(t) >= np.log(0.3 / 0.7) for t in neutral) < sum(free.logit(t) >= np.log(0.3 / 0.7) for t in neutral)
    long = "z" * 300_000
    assert toxicity.Scorer({long: 1.0}, 0.0).logit(f"a {long}") == 1.0


def test_pairs_come_from_the_given_documents(spark):
    d = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    assert model.pairs > 1000


# Urls.


def test_rules_and_parsing(spark):
    urls = [("HTTP://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://a.example.com/en/2#f", "a.example.com", "/en/2", "example.com/en/", "block"), ("x://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"), ("http://b.com", "b.com", "", None, None), ("http://b.com/p", "b.com", "/p", "com/", "allow"), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://notcom/x", "notcom", "/x", None, None), ("http://É.net?q", "É.net", "", None, None)]
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, outcomes, registered.URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert url_reputation.judge(pages.limit(0), outcomes, registered.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rows, out = [], []
    for h, (n, good) in {"bad.x.org": (200, 10), "fine.x.org": (200, 190), "few.y.org": (1, 0), "new.y.org": (0, 0)}.items():
        for _ in range(max(n, 1)):
            rows.append((len(rows), f"http://{h}/p"))
            if n:
                out.append((len(rows) - 1, int(len(out) % n < good) if n > 1 else 0))
    flags, seen = [], collections.Counter()
    for page, _ in out:
        host = rows[page][1]
        limit = {"http://bad.x.org/p": 10, "http://fine.x.org/p": 190}.get(host, 0)
        flags.append((page, int(seen[host] < limit)))
        seen[host] += 1
    got = url_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(flags, "page_id long, good int"), [])
    by = {r["host"]: r for r in got.collect()}
    assert by["bad.x.org"]["verdict"] == "block" and by["fine.x.org"]["verdict"] == "allow"
    assert by["few.y.org"]["verdict"] == "allow" and by["few.y.org"]["posterior"] < by["new.y.org"]["posterior"]
    assert by["bad.x.org"]["posterior"] == pytest.approx(0.05, abs=0.02)


def test_outcomes_come_from_the_text(spark):
    pages = spark.createDataFrame([(7, "<nav>x</nav><article class=a><h1>One two</h1><p>One two,<br>caf\u00e9 &amp; three</p></article>"), (8, "<article><p>other</p></article>"), (9, None), (1, "no article")], "page_id long, html string")
    texts = docs(spark, [(1, "One two, CAF\u00c9 & three"), (2, "one two caf\u00e9 three!"), (8, "unlike"), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 1, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in registered.page_outcomes(pages, texts, labels).collect()] == [(7, 0)]
    found = registered.page_outcomes(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents", "labels")))
    assert found.count() > 0


def test_odd_outcomes(spark):
    """Null outcomes, repeated pages and repeated labels."""
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/x"), (2, "http://b.org/"), (None, "http://c.org/"), (3, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "page_id long, good int")
    got = url_reputation.judge(pages, outcomes, []).collect()
    by = {r["host"]: r["posterior"] for r in got}
    assert len(got) == 5 and by["a.org"] < by["b.org"] and set(by) == {"a.org", "b.org", "c.org", ""}


# Main texts.


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class='sidebar'>side</div><div class=cookie-notice>We use cookies</div>%s<form><label>Name</label></form><section id=comments><p>first!</p></section><footer>&copy; us</footer><script>var a='<p>x</p>';</script></body></html>"


@pytest.mark.parametrize("body,want", [
    ("<article><h1>A &amp; B</h1><p>One\n two<p>Three <b>bold</b>x<br>y</article>", ["A & B", "One two", "Three boldx y"]),
    ("<article><p>kept<div class=ad>buy</div><p>on</article>", ["kept", "on"]),
    ("<main><div><p>plain</p></div><!-- <p>no</p> --></main>", ["plain"]),
    ("<article><p>cut off &am", ["cut off &am"]),
    ("<article data-title='Hidden treasures'><p title='a hidden valley'>one<div data-id=nav data-role=banner>two</div><h1 class=entry-header>three</h1>", ["one", "two", "three"]),
    ("<article><div class=related-work>a</div><p>x <math><mi>y</mi></math> z<object>b</object><div class=related-posts>no</div><div class='entry-header'><h2>c</h2></div>", ["a", "x y zb", "c"]),
    ("<div class=post>teaser</div><div><p>all the rest of the page</p></div>", ["teaser", "all the rest of the page"]),
    ("<div class='post-content'><p>nearly all the text there is</p></div><div>other</div>", ["nearly all the text there is"]),
    ("<article><header><h2>Title</h2></header><p>1 &lt; 2 < 3</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["Title", "1 < 2 < 3", "a", "b", "c", "d"]),
])
def test_blocks(body, want):
    page = PAGE % body
    if "cut off" in body or "<table>" in body:
        page = page[: page.index("<form>")]
    assert site_tree.chosen(site_tree.blocks(page)[0], set()) == want


def test_classes_of_the_body_say_nothing():
    assert site_tree.chosen(site_tree.blocks("<article><p class=x title='abc>text</p><p>more <i>of</i> it")[0], set()) == ["text", "more of it"]
    assert site_tree.chosen(site_tree.blocks("<html class=no-ads><body class='has-sidebar menu'><p>text")[0], set()) == ["text"]


def test_templates_without_names_are_learned(spark):
    rng = random.Random(8)
    page = lambda i: f"<body><div class=top><p>Welcome to our shop of all things</p></div><div class=txt>{''.join(f'<p>{words(rng, 12)}</p>' for _ in range(1 + i % 4))}</div><div class=end>Call us at any time</div></body>"
    rows = [(i, f"http://h.org/{i}", page(i), "x") for i in range(30)] + [(50, "http://lone.org/", page(1), "x"), (51, None, None, "x"), (52, "http://h.org/", "", "x"), (53, "q", "<p>" + "z" * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    for i, _, h, _ in rows[:30]:
        assert got[i] == "\n\n".join(re.findall(r"<p>(w[^<]*)</p>", h))
    assert got[50].startswith("Welcome") and got[51] == got[52] == "" and len(got[53]) == 100_000
    assert site_tree.extract(df.limit(0)).count() == 0


def test_the_style_tree_judges_articles_too(spark):
    rng = random.Random(12)
    copy = words(rng, 40)
    page = lambda i, body: f"<body><div class=top>Welcome to all</div><article><h1>{words(rng, 4)}</h1><p>{body}</p><div class=legal>All rights are with us</div></article><div class=more><p>{words(rng, 9)}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page(i, words(rng, 30))) for i in range(20)] + [(i, f"http://h.org/{i}", page(i, copy)) for i in range(20, 60)]
    rows += [(i, f"http://same.org/{i}", f"<article><h1>One title</h1><p>{copy}</p></article>") for i in range(60, 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    for i, _, h in rows[:60]:
        assert got[i].split("\n\n") == re.findall(r"<(?:p|h1)>(w[^<]*)</", h)
    assert {got[i] for i in range(60, 80)} == {f"One title\n\n{copy}"}


def test_importance_equals_brute_force(spark):
    """Entropies of a style tree counted by hand: texts by path, patterns by path, articles once however often copied."""
    rng = random.Random(22)
    rows = [(h, 7, kind, rng.randrange(6), rng.choice([None, None, 1, 2, 3]) if kind == 1 else None, rng.randrange(1, 9)) for h in ("a", "b") for kind in (0, 1) for _ in range(40)]
    rows = list({r[:5]: r for r in rows}.values()) + [(h, 0, 2, w, w, 4) for h in ("a", "b") for w in (1, 2, 3)]
    sizes = {"a": 90, "b": 120}
    copies = spark.createDataFrame(rows, "host string, path long, kind int, digest long, whole long, c long")
    got = {(r["host"], r["kept"]): r for r in site_tree.importance(copies, spark.createDataFrame(list(sizes.items()), "host string, pages long"), "host").collect()}
    for h in sizes:
        for kept in (False, True):
            count, n = [collections.Counter(), collections.Counter()], 3 if kept else sizes[h]
            for host, _, kind, digest, whole, c in rows:
                if host == h and kind < 2 and (whole is not None) == kept:
                    count[kind][digest] += 1 if kept else c
            assert got[h, kept]["content"] == pytest.approx(1 - np.mean([np.log(c) / np.log(n) for c in count[1].values()]))
            if not kept:
                p = np.array(list(count[0].values())) / sum(count[0].values())
                assert got[h, kept]["presentation"] == pytest.approx(-(p * np.log(p)).sum() / np.log(n))


def test_small_hosts_use_their_domain(spark):
    rng = random.Random(23)
    page = lambda i: f"<body><div class=top><p>Welcome to our shop of all things</p></div><div class=txt><p>{words(rng, 30)}</p></div></body>"
    rows = [(i, f"http://h{i % 6}.shop.org/{i}", page(i)) for i in range(24)] + [(100, "http://alone.net/", page(0))]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in got[i] and len(got[i].split()) == 30 for i in range(24)) and "Welcome" in got[100]


def test_pages_equal_their_articles(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registered.op8_main_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", rows[r["page_id"]], re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# Nearest neighbours.


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[100:140] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (None, [1.0] * 16), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, r, "x") for i, r in rows], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, 20, leaf_rows=180).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d = v.astype(np.float64)
    found = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, near in got.items():
        scores = d @ d[q]
        assert len(near) == 20 == len(set(near)) and all(i != q and abs(scores[i] - s) < 1e-9 for i, s in near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        found += len({i for i, _ in near} & set(want))
    assert found >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[0]] [:3] == [100, 101, 102] or d[0] @ d[0] < max(d @ d[0])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.2, 0.1])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann.search(few.limit(0), F.lit(True), 20).count() == 0


def test_clustered_vectors_need_few_rows(spark):
    """Forty clusters: every query gets its k rows, and its opened leaves hold less than a third of all rows a tree."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24)) * 4
    v = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 24)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 200 == 0, 20, leaf_rows=125).collect():
        got[r["query_id"]].append(r["vec_id"])
    d = v.astype(np.float64)
    found = sum(len(set(got[q]) & set(sorted((i for i in range(8000) if i != q), key=lambda i: (-(d[i] @ d[q]), i))[:20])) for q in range(0, 8000, 200))
    assert all(len(got[q]) == 20 for q in range(0, 8000, 200)) and found >= 0.9 * 20 * 40
    largest = (d * d).sum(axis=1).max()
    points = np.hstack([d, np.sqrt(largest - (d * d).sum(axis=1))[:, None]])
    forest = ann.Forest(points, 6, 6, 17)
    share = ann.calibrated(forest, points, d, 20, 0.95)
    assert share < 1 / 3 and 6 * share < 2
    rows = np.zeros_like(forest.sizes)
    rows[:, ::2] = 5
    assert max(sum(rows[c >> 6, c & 63] for c in forest.opened(points[0], 0.0, rows, 21) if c >> 6 == t) for t in range(6)) >= 21


def made_by_cogroups(spark):
    """Rows that the last execution with a cogroup made in it."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    for run in reversed([runs.apply(i).executionId() for i in range(runs.size())]):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in [nodes.apply(i) for i in range(nodes.size())]:
            if node.name().startswith("FlatMapCoGroupsInPandas"):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                return next(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows")
    raise AssertionError


def test_short_lists_grow_with_the_queries(spark):
    """Vectors without structure, whose queries open more leaves the more there are: four times the rows make four
    times the short lists."""
    rng = np.random.default_rng(5)
    v, made = rng.normal(size=(4000, 16)), []
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v[:n])], "vec_id long, embedding array<double>")
        assert ann.search(df, F.col("id") % 20 == 0, 20, leaf_rows=60).count() == n // 20 * 20
        made.append(made_by_cogroups(spark))
    assert made[1] <= 4.5 * made[0]


def test_branches_hold_every_leaf_once():
    sizes = np.array([[10, 20, 30, 900, 5, 5, 5, 5], [1] * 8])
    of, parts = ann.branches(sizes, 100)
    assert of.tolist() == [[0, 0, 1, 2, 3, 3, 3, 3], [4] * 8] and parts.tolist() == [1, 1, 9, 1, 1]


def test_registered_search_reaches_its_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"]}
    ids, v = np.array(list(rows)), np.stack(list(rows.values()))
    got = collections.defaultdict(set)
    for r in registered.op9_nearest(spark, d).collect():
        got[r["query_id"]].add(r["vec_id"])
    found = 0
    for q in got:
        scores = v @ rows[q]
        scores[ids == q] = -np.inf
        found += len(got[q] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert set(got) == {i for i in rows if i % 20 == 0} and found >= 0.9 * 20 * len(got)


# Shards.


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3, first_tier_bytes=100_000)
    parts = [docs(spark, [(10 * k + i, f"text {i}" if i else None) for i in range(5)]) for k in range(7)]
    for p in parts:
        store.append(p)
    assert len(store.shards()) == 7 and store.read(3).count() == 15
    stale = shards.ShardStore(spark, store.path)
    store.compact()
    assert len(store.shards()) < 3 and store.read().count() == 35
    assert sorted((r["doc_id"], str(r["text"])) for r in store.read().collect()) == sorted((r["doc_id"], str(r["text"])) for p in parts for r in p.collect())
    with pytest.raises(shards.CommitConflict):
        stale._commit(stale.manifest(7 - 1), parts[0].schema, [], "late")
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    before = store.read().count()
    store.append(docs(spark, []))
    assert store.read().count() == before and store.vacuum()
    empty = shards.ShardStore(spark, str(tmp_path / "e"))
    empty.append(docs(spark, []))
    assert empty.read().count() == 0 and empty.compact()["version"] == 1


def test_vacuum_loses_nothing(spark, tmp_path):
    """A late commit, a shard that isn't committed yet, a reader that holds a version, and columns with taken names."""
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    part = lambda k: docs(spark, [(100 * k + i, f"text {i}") for i in range(50)])
    first = store.append(part(0))
    late = store._write(part(1))
    for k in (2, 3, 4, 5):
        store.append(part(k))
    with store.pinned(2) as held:
        store.compact()
        store.vacuum()
        assert held.count() == store.read(2).count() == 100
    gone = store.vacuum()
    assert gone and late.name not in gone
    for version in (1, 2):
        with pytest.raises(shards.VersionRemoved):
            store.read(version)
    with pytest.raises(shards.CommitConflict):
        store._commit(first, part(1).schema, [*store.shards(), late], "late")
    base = store.manifest()
    store._commit(base, part(1).schema, [*store.shards(), late], "append")
    assert store.read().count() == 300 and not store.vacuum()
    orphan = store._write(part(9))
    assert store.vacuum(orphan_seconds=-60) == [orphan.name] and store.read().count() == 300
    clash = docs(spark, [(1, "x")]).withColumnRenamed("start", "shard").withColumnRenamed("maybe_id", "version")
    row = shards.compacted(shards.ShardStore(spark, str(tmp_path / "c")), [clash]).first()
    assert row["shard"] == "s" and row["version"] == "m" and row["shard_"].startswith("shard-")


def test_sizes_change_no_row(spark, tmp_path):
    """No rows, one row or all, in shards that are merged often, once or never: the same rows as were given."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for n in (0, 1):
        given.limit(n).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        rows = registered.op2_compaction(spark, str(tmp_path / f"{n}"))
        assert rows.count() == n and rows.columns == ["doc_id", "lang", "source", "n_chars", "text_chars", "text_md5"]
    want = sorted(map(repr, given.collect()))
    arrivals = [given.where(F.col("doc_id") % 5 == i) for i in range(5)]
    for target, first in ((1 << 40, 1 << 40), (1 << 16, 1 << 10), (1, 1)):
        store = shards.ShardStore(spark, str(tmp_path / f"{target}"), target_bytes=target, first_tier_bytes=first)
        assert sorted(map(repr, shards.compacted(store, arrivals).select(*given.columns).collect())) == want


def test_shards_keep_long_texts(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 16, fan_in=2, first_tier_bytes=1 << 10)
    rng = random.Random(20)
    arrivals = [docs(spark, [(10 * k + i, "".join(rng.choices("abcdefghij ", k=60_000))) for i in range(3)] + ODD) for k in range(4)]
    rows = shards.compacted(store, arrivals)
    assert rows.count() == 4 * (3 + len(ODD)) and rows.agg(F.max(F.length("text"))).first()[0] == 200_000
    grown = {s.name for s in store.shards() if s.bytes >= store.target_bytes}
    store.append(arrivals[0])
    store.compact()
    assert grown and grown <= {s.name for s in store.shards()}


# Shared parts and the pipeline.


def test_id_filter_is_exact_after_the_join(spark):
    df = docs(spark, [(i, "t") for i in range(300)] + ODD)
    gone = spark.range(0, 300, 3)
    held = IdFilter(gone, "id")
    assert held.words.nbytes == IdFilter.BITS // 8
    kept = without_ids(df, "doc_id", gone)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [*(i for i in range(300) if i % 3), *(i for i, _ in ODD)])


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    current, kept = given, {"given": given.collect()}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF).cache()
        kept[name] = current.collect()
        if name != "packing":
            assert current.columns == given.columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in ids["quality"]) and all(i in ids["quality"] for i, q in labels.items() if q == 1)

    # Near duplicates: all pairs.
    with np.errstate(over="ignore"):
        made = {r["doc_id"]: near_dup.shingles(near_dup.word_hashes(r["text"]), 5) for r in kept["quality"] if near_dup.word_hashes(r["text"] or "").size}
    root = {i: i for i in made}
    order = sorted(made)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if min(len(made[a]), len(made[b])) >= 0.8 * max(len(made[a]), len(made[b])) and root[a] != root[b] and near_dup.aligned_similarity(made[a], made[b], 0.8) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert ids["near_duplicates"] == (ids["quality"] - set(made)) | {i for i, r in root.items() if i == r}

    # Repeated passages: no 60 words of one document are left in a later one, and clean texts are whole.
    before, after = ({r["doc_id"]: (r["text"] or "").split() for r in kept[n]} for n in ("near_duplicates", "substring_dedup"))
    seen: dict[tuple, int] = {}
    for i in sorted(before):
        for k in range(len(before[i]) - 59):
            seen.setdefault(tuple(before[i][k : k + 60]), i)
    assert not [i for i, w in after.items() for k in range(len(w) - 59) if seen.get(tuple(w[k : k + 60]), i) < i]
    owners: dict[tuple, set] = collections.defaultdict(set)
    for i, w in before.items():
        for k in range(len(w) - 11):
            owners[tuple(w[k : k + 12])].add(i)
    alone = [i for i, w in before.items() if all(len(owners[tuple(w[k : k + 12])]) == 1 for k in range(len(w) - 11))]
    assert len(alone) > 50 and all(after[i] == before[i] for i in alone if before[i])

    # Benchmark passages: whole items are gone, texts without eight common words in a row stay.
    token = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    items = [token(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    for r in kept["substring_dedup"]:
        text = f" {' '.join(token(r['text']))} "
        if any(f" {' '.join(w)} " in text for w in items if w):
            assert r["doc_id"] not in ids["decontamination"]
        elif not any(tuple(token(r["text"])[k : k + 8]) in grams for k in range(len(token(r["text"])) - 7)):
            assert r["doc_id"] in ids["decontamination"]

    # Packing: every token once.
    plain = Tokenizer.from_file(registered.tokenizer_path())
    want = {r["doc_id"]: plain.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in kept["decontamination"]}
    for rows in (kept["packing"], corpus_pipeline.run(spark, SF).collect()):
        pieces = collections.defaultdict(dict)
        for r in rows:
            pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert {i: [x for _, p in sorted(parts.items()) for x in p] for i, parts in pieces.items()} == want


def test_encoder_equals_the_file(spark):
    from tokenizers import Tokenizer

    plain, fast, rng = Tokenizer.from_file(registered.tokenizer_path()), packing.encoder(registered.tokenizer_path()), random.Random(24)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect() if r["text"]]
    alphabet = "abcXYZ  \t\n\r.,;'\"0129²½ºéßñ日本語ไทย\u00a0\u200b\u2028\x1c\x85👍🏽<|>'s've'Re"
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(fast.encode(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t

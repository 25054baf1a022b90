from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from spindrift.llm import op3_simhash as op3
from spindrift.llm import op4_substring as op4
from spindrift.llm import op5_quality as op5
from spindrift.llm.graph import connected_components
from spindrift.llm.simhash_kernels import bucket_forest, fingerprint

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "a b c"), (6, "A b C d e"), (6, "A b C d e"), (None, "null id text here now"), (8, "x " * 20000), (9, "é ü ß 日本 語\x0b\x0c")]


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def slow_print(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [t for _, t in ODD if t is None or len(t) < 1000] + ["Straße ÄÖÜ A\x0bB\x0cC D E F G"])
def test_fingerprint_equals_slow_code(text):
    assert fingerprint(text) == slow_print(text)


def test_index_covers_every_four_positions():
    triples = [set(t) for t in op3.index_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def slow_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def test_bucket_forest_links_what_all_pairs_link():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for _ in range(150)})
    a, b = bucket_forest(np.array(prints, np.uint64), np.zeros(len(prints), np.uint8), 4, 4, tile=32)
    assert len(a) < len(prints)
    joined = {p: p for p in prints}
    for x, y in zip(a.tolist(), b.tolist()):
        joined[x] = y
    slow = slow_components(prints)
    assert len(set(joined.values())) == len(set(slow.values()))


@pytest.mark.parametrize("block", [8192, 7])
def test_links_match_brute_force_for_any_block_size(spark, block):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots, _ = connected_components(op3.fingerprint_links(table, block=block))
    got = {r["node"] & (2**64 - 1): r["root"] for r in roots.collect()}
    slow = slow_components(prints)
    classes = Counter(slow.values())
    for p, r in slow.items():
        assert (p in got) == (classes[r] > 1)
    for a, b in combinations(got, 2):
        assert (got[a] == got[b]) == (slow[a] == slow[b])


def test_components_of_a_long_chain_and_nulls(spark):
    rows = [(k, k + 1) for k in range(60)] + [(100, 100), (None, 3), (7, None), (200, 199)]
    found, _ = connected_components(spark.createDataFrame(rows, "a long, b long"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {**{k: 0 for k in range(61)}, 199: 199, 200: 199}
    empty, _ = connected_components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


def test_near_dedup_of_odd_rows(spark):
    rows = ODD + [(20, "w " * 19999 + "w"), (21, "One"), (30, "one")]
    table = docs(spark, [(i, t, 1, "c") for i, t in rows], ", fp int, component_id string")
    got = [(r["doc_id"], r["component_id"]) for r in op3.simhash_components(table).collect()]
    assert len(got) == len(rows)
    prints = {t: slow_print(t) if t is None or len(t) < 1000 else fingerprint(t) for _, t in rows}
    slow = slow_components(set(prints.values()))
    smallest = {}
    for i, t in rows:
        r = slow[prints[t]]
        smallest[r] = i if smallest.get(r) is None else smallest[r] if i is None else min(smallest[r], i)
    assert Counter(got) == Counter((i, smallest[slow[prints[t]]]) for i, t in rows)
    kept = op3.keep_one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == sorted((i is not None, i or 0) for i in set(smallest.values()))
    assert op3.simhash_components(docs(spark, [])).count() == 0 and op3.keep_one_of_each(docs(spark, [])).count() == 0


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(1)
    made = [(100 + k, "".join(rng.choice(["the ", "a ", "b\n", "\n", "#|", " \t", "no, ", "x<>"]) for _ in range(rng.randrange(400)))) for k in range(60)]
    return ODD + made + [(300, "the kitten and the doggy of course " * 30), (301, ("the word%d of thing%d " * 30) % tuple(range(60))), (302, ("za%d " * 60) % tuple(range(60)))]


def test_measures_equal_slow_code(spark):
    rows = quality_rows()
    table = docs(spark, [(i, t, -1, "old") for i, t in rows], ", n_words long, kept string")
    got = op5.quality(table).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((i, *measures(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    verdict = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in got}
    assert verdict[300] == (False, []) and verdict[301][0] and verdict[302] == (False, ["stop_word_ratio"])


def test_rejected_rows_go_and_columns_stay(spark):
    table = docs(spark, [(i, t, 7, "s") for i, t in quality_rows()], ", kept int, `odd name` string")
    kept = op5.drop_rejected(table)
    assert kept.columns == table.columns and 301 in {r["doc_id"] for r in kept.collect()} and {r["kept"] for r in kept.collect()} == {7}
    assert op5.quality(docs(spark, [])).count() == 0


def test_no_user_function_in_the_quality_plan(spark, sf_dir):
    plan = op5.op5_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    a, b = op5.op5_quality_rules(spark, sf_dir).toPandas(), con.sql(op5.ORACLE_SQL).df()
    order = lambda d: d[sorted(d.columns)].astype(str).sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b))


def test_clean_labelled_documents_stay_and_junk_goes(spark):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no labels")
    got = op5.quality(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == bool(r["quality"]) for r in got) and len(got) > 100


def slow_units(text):
    """(start, end, words) of each unit, by a walk over the text that shares no code with the operator."""
    out, held = [], []
    sentence = []
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\s。！？]*[。！？]|[^\s。！？]+", text)]
    for k, (a, b) in enumerate(tokens):
        sentence.append((a, b, text[a:b].lower()))
        gap = text[b : tokens[k + 1][0]] if k + 1 < len(tokens) else "\n"
        if "\n" in gap or text[b - 1] in "。！？" or gap[:1] in (" ", "\t") and re.search(r"[.!?…][\"')\]]*$", text[a:b]):
            for n, (x, y, w) in enumerate(sentence, 1):
                held.append((x, y, w))
                if n == len(sentence) or len(sentence) > 12 and xxhash.xxh3_64_intdigest(w) % 4 == 0:
                    out.append((held[0][0], held[-1][1], [w for _, _, w in held]))
                    held = []
            sentence = []
    return out


def slow_keys(text):
    """(first unit, last unit, words) of the whole text, then of each unit with what follows up to four words."""
    found = slow_units(text)
    weigh = lambda ws: sum(len(w) // 2 if len(w) > 24 and not w.isascii() else 1 for w in ws)
    out = [(0, len(found) - 1, ("whole", *(w for u in found for w in u[2])))] if found else []
    for i in range(len(found)):
        j = i
        while weigh(w for u in found[i : j + 1] for w in u[2]) < 4 and j + 1 < len(found):
            j += 1
        out.append((i, j, tuple(w for u in found[i : j + 1] for w in u[2])))
    return found, out, weigh


def slow_substrings(rows, min_words=22):
    ids = {}
    for i, t in rows:
        for _, _, ws in slow_keys(t or "")[1]:
            ids.setdefault(ws, set()).add(i)
    out = []
    for i, t in rows:
        t = t or ""
        found, keys, weigh = slow_keys(t)
        seen, gone = {}, [False] * len(found)
        for a, b, ws in keys:
            rest = [x for x in ids[ws] if x is not None]
            earlier = any(i is None or x < i for x in rest)
            overlapped = ws in seen and seen[ws] >= a
            if ws in seen and seen[ws] < a or earlier and not overlapped:
                gone[a : b + 1] = [True] * (b + 1 - a)
            seen.setdefault(ws, b)
        whole = bool(keys) and any(i is None or x < i for x in ids[keys[0][2]] if x is not None)
        spans, k = [], 0
        while k < len(found):
            e = k
            while e < len(found) and gone[e]:
                e += 1
            if e > k and (whole or weigh(w for u in found[k:e] for w in u[2]) >= min_words):
                spans.append((found[k][0], found[e - 1][1]))
            k = e + 1
        ends, starts = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)]
        out.append((i, "".join(t[a:b] for a, b in zip(ends, starts)), tuple(spans)))
    return out


def substring_rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n))
    passage = ". ".join(say(9) for _ in range(8)) + "."
    line = say(45)
    rows = list(ODD)
    for k in range(12):
        rows.append((50 + k, f"{say(20)}.\n{passage if k % 2 else say(70)}\n{line if k % 3 == 0 else ''}\n{say(12)}. Ok. {say(8)}."))
    rows.append((90, f"{say(7)} {passage} {say(5)}"))
    rows.append((91, f"{line}\n{line}\n{say(6)}"))
    return rows + [(50, rows[len(ODD)][1]), (60, "another text of the same id " + passage)]


def test_substring_dedup_equals_slow_code(spark):
    rows = substring_rows()
    table = docs(spark, [(i, t, 0, "x") for i, t in rows], ", gone int, spans string")
    got = Counter((r["doc_id"], r["text"], tuple(map(tuple, r["removed"]))) for r in op4.dedup_substrings(table).collect())
    assert got == Counter(slow_substrings(rows))
    cut = {r["doc_id"]: r["n_removed_words"] for r in op4.dedup_substrings(table).collect()}
    assert cut[53] >= 50 and cut[90] >= 50 and cut[91] >= 45
    assert op4.dedup_substrings(docs(spark, [])).count() == 0


def test_units_equal_a_walk_over_the_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "a", "B. ", "c.\") ", "\n", "日本。", "！", " ", "\t", "é", ".x ", "\x1cq ", "İ ", "long" * 9 + "é "]) for _ in range(rng.randrange(120))) for _ in range(400)]
    for text in [*texts, "One two. Three four five!\n" + " ".join(f"w{k}" for k in range(200)) + "\n\n  end"]:
        found, slow = op4.units(text), slow_keys(text)
        if found is None:
            assert not slow[0]
            continue
        assert [(int(found.starts[a]), int(found.stops[b])) for a, b in zip(found.first, found.last)] == [u[:2] for u in slow[0]]
        assert found.to.tolist() == [j for _, j, _ in slow[1][1:]]
        same = {}
        assert all(same.setdefault(d, ws) == ws for d, (_, _, ws) in zip(found.digests.tolist(), slow[1])) and len(same) == len({ws for _, _, ws in slow[1]})


def query_substrings(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return {r["doc_id"]: r for r in op4.op4_substring_dedup(spark, str(tmp_path)).collect()}


def test_every_repeated_passage_of_fifty_words_is_cut(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n))
    made = [" ".join(say(n) + "." for n in sizes) for sizes in ((14, 13, 14, 14), (2, 3, 22, 3, 2, 3, 18), (3,) * 17, (52,), (20, 8, 3, 20))]
    rows = [(k, f"{say(40)}. {p} {say(40)}.") for k, p in enumerate(made)]
    rows += [(100 + k, f"{say(11)} {p} {say(7)}") for k, p in enumerate(made)] + [(200, f"{say(60)}.")]
    got = query_substrings(spark, tmp_path, rows)
    assert not any(got[k]["removed"] for k in (0, 1, 2, 3, 4, 200))
    for k in range(len(made)):
        assert 22 <= got[100 + k]["n_removed_words"] <= 70 and got[100 + k]["text"].startswith(rows[len(made) + k][1][:20])


def test_text_of_short_units_and_short_copies_are_cut(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(900))
    items = "\n".join(f"{word()} {word()}" for _ in range(40))
    shout = " ".join(word().upper() + "!!" for _ in range(60))
    plain = "\n".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(3))
    loose = "\n".join(f"{rng.choice(['yes', 'no'])} {word()}" for _ in range(40))
    rows = [(1, items), (2, shout), (3, plain), (4, "a copy of few words"), (5, loose), (6, "yes\nno\n" * 2)]
    rows += [(11, f"head {word()}\n{items}\ntail {word()}"), (12, shout), (13, f"{plain}\nend"), (14, " A copy of\nfew words"), (15, "\n".join(sorted(loose.split("\n"))))]
    got = query_substrings(spark, tmp_path, rows)
    assert not any(got[k]["removed"] for k in range(1, 7)) and not got[15]["removed"]
    assert got[11]["n_removed_words"] >= 77 and got[12]["text"] == "" and got[13]["text"].strip() == "end" and got[14]["text"].strip() == ""


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_components(texts, similarity=0.8):
    """Smallest id reachable over pairs of texts of a Jaccard similarity, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def near_rows():
    rng = random.Random(31)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, k = [], 0
    for changes in (0, 1, 3, 6, 8, 10, 12, 16, 30, 60):
        base = say(400)
        rows.append((k, " ".join(base)))
        for copy in range(1, 5):
            other = list(base)
            for at in rng.sample(range(400), changes):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((k + copy, " ".join(other).upper() if copy == 2 else " ".join(other)))
        k += 10
    return rows


def test_near_components_equal_all_pairs(spark):
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in op3.near_components(docs(spark, [(i, t, 1, "x") for i, t in rows], ", fp int, node string")).collect()}
    assert got == jaccard_components(dict(rows))
    # lists cut into many blocks give the same classes
    cut = {r["doc_id"]: r["component_id"] for r in op3.near_components(docs(spark, rows), block=2).collect()}
    assert cut == got


def test_large_buckets_link_what_small_ones_do():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, size=(3, 8), dtype=np.uint64)
    prints = []
    for k in range(90):
        bits = np.unpackbits(base[k % 3].view(np.uint8))
        bits[rng.choice(512, int(rng.integers(0, 40)), replace=False)] ^= 1
        prints.append(np.packbits(bits).view(np.uint64))
    prints = np.array(prints)
    for side in (np.zeros(90, np.uint8), (np.arange(90) % 2).astype(np.uint8)):
        a, b, bits = op3.small_bucket_links(np.zeros(90, np.int64), prints, side, 6, 97)
        slow = {(i, j) for i, j in combinations(range(90), 2) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 97 and (not side.any() or side[i] != side[j])}
        assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == slow
        x, y, few = op3.large_bucket_links(prints, side, 6, 53, 97)
        assert len(x) < len(a) and {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())} <= slow
        parent = list(range(90))

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for p, q in zip(x.tolist(), y.tolist()):
            parent[find(p)] = find(q)
        assert len({find(v) for v in range(90)}) == 3


def test_near_components_of_odd_rows(spark):
    rows = ODD + [(20, "ONE"), (21, None), (None, "One")]
    got = Counter((r["doc_id"], r["component_id"]) for r in op3.near_components(docs(spark, rows)).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 1), (21, 1), (4, 4), (20, 4), (None, 4), (5, 5), (6, 6), (6, 6), (None, None), (8, 8), (9, 9)])
    kept = op3.keep_one_of_each(docs(spark, rows), op3.near_components)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, None, 8, 9])
    assert op3.near_components(docs(spark, [])).count() == 0


def crowded_pair():
    """Two rows of 60 differing bits, and around each four rows that are nearer to it but in clusters of their own."""
    rng = np.random.default_rng(11)
    bits = np.unpackbits(rng.integers(0, 1 << 63, size=8, dtype=np.uint64).view(np.uint8))
    spots = rng.permutation(512)

    def moved(base, at):
        out = base.copy()
        out[at] ^= 1
        return out

    p, q = bits, moved(bits, spots[:60])
    around = [moved(base, spots[60 + 55 * k : 115 + 55 * k]) for base, ks in ((p, range(4)), (q, range(4, 8))) for k in ks]
    return np.array([np.packbits(x).view(np.uint64) for x in (p, q, *around)])


def test_open_pairs_beyond_the_nearest_are_marked_and_then_named():
    prints, none = crowded_pair(), np.zeros(10, np.uint8)
    x, y, _ = op3.large_bucket_links(prints, none, 6, 53, 97)
    assert (0, 1) not in {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
    ids = np.arange(10, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (ids * 0 + 77, ids * 0, ids * 0, ids, ids, ids * 0)] + [pa.array([p.tobytes() for p in prints])], names=["key", "lo", "hi", "node", "root", "block", "fp"])
    rows = lambda *a: [tuple(r.values()) for out in op3._wide_links(53, 97, *a)(iter([batch])) for r in out.to_pylist()]
    assert (77, None, None) in rows(3, 4)
    # in the second search the pair is decided by its sets: 0.8 links, less does not
    for shared, linked in ((8, True), (7, False)):
        sets = [np.arange(9, dtype=np.int32), np.append(np.arange(shared), 50).astype(np.int32), *(np.array([100 + i], np.int32) for i in range(8))]
        x, y = op3.verified_links(prints, none, ids, sets, 6, 53, 97, 0.8)
        assert ((0, 1) in zip(x.tolist(), y.tolist())) == linked
        whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))], names=[*batch.schema.names, "held"])
        assert ({"a": 0, "b": 1} in [r for out in op3._settled_links(53, 97, 0.8)(iter([whole.slice(0, 3), whole.slice(3)])) for r in out.to_pylist()]) == linked
        # known components leave out what they join
        assert not op3.verified_links(prints[:2], none[:2], np.array([5, 5]), sets[:2], 6, 53, 97, 0.8)[0].size


def test_near_components_of_crowded_lists_equal_all_pairs(spark):
    rng = random.Random(77)
    say = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = []
    for group in range(3):
        base = say(300)
        for copy in range(16):
            other = list(base)
            for at in rng.sample(range(300), 5 + copy // 4):
                other[at] = f"x{rng.randrange(9000)}"
            rows.append((group * 100 + copy, " ".join(other)))
    got = {r["doc_id"]: r["component_id"] for r in op3.near_components(docs(spark, rows), nearest=1, small=1).collect()}
    assert got == {r["doc_id"]: r["component_id"] for r in op3.near_components(docs(spark, rows), small=64).collect()}

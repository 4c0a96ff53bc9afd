import random
import re

import xxhash

from strandloom.llm import lines, minhash, simhash
from strandloom.llm.components import components

SCHEMA = "doc_id long, text string, bits string, anchor int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near(text, changes, seed):
    parts, r = text.split(), random.Random(seed)
    for _ in range(changes):
        parts[r.randrange(len(parts))] = f"new{r.randrange(10**6)}"
    return " ".join(parts)


BASE = words(400, 1)
TEXTS = [BASE, BASE.upper(), near(BASE, 1, 2), near(BASE, 2, 3), near(BASE, 150, 4), words(300, 5), None, "", " \n\t ", "one", "one two", "one two three", "One two three", words(3, 6) + "\x85é", words(5000, 7)]
ROWS = [(i * 3 + 1, t, "b", i) for i, t in enumerate(TEXTS)] + [(1, BASE, "b", 0), (None, BASE, "b", 0)]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_all_pairs(spark):
    got = simhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", simhash.hexadecimal("bits").alias("f"), "component_id").collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    group = list(range(len(prints)))
    for a, (_, x) in enumerate(prints):
        for b, (_, y) in enumerate(prints):
            if (x ^ y).bit_count() <= 2:
                group = [group[a] if g == group[b] else g for g in group]
    want = [(i, f"{f:016x}", min(prints[k][0] for k in range(len(prints)) if group[k] == group[n] and prints[k][0] is not None)) for n, (i, f) in enumerate(prints)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_lose_no_link(spark):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(30)}
    for x in list(prints):
        for flips in (1, 2, 3, 4):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), flips)))
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "bits long")
    for threshold in (0, 1, 2, 3):
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}
        assert {tuple(p) for p in simhash.links(frame, threshold).collect()} == want


def test_near_copies_by_similarity(spark):
    rows = [(i, near(BASE, 1, i), "b", 1) for i in range(10, 40)] + [(5, BASE, "b", 1), (6, BASE, "b", 1), (50, words(300, 9), "b", 1), (51, near(BASE, 200, 10), "b", 1), (60, "", "b", 1), (61, None, "b", 1), (None, BASE, "b", 1), (5, BASE, "again", 1)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "bits", "anchor"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "5", "50", "51", "60", "None"])
    assert simhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20, 60)] + [(7, 7), (3, 1), (1, 3), (9, 3), (100, 60), (None, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 20 for i in [*range(20, 61), 100]} | {1: 1, 3: 1, 9: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    owners, key = {}, lambda line: lower(line.strip(" \t\n\v\f\r"))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        out.append((str(i), "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out)


LINES = [(4, "A common line here\nunique in four\n  a COMMON line here\t\nshort"), (2, "a common line here \r\nshort\n\n"), (9, None), (8, ""), (3, "éééééééééé\nééééééééé\n"), (5, "Éééééééééé\néééééééééé\nééééééééé"), (5, "repeated row five\na common line here"), (None, "a common line here"), (6, "repeated row five"), (7, "x\n" * 5000 + "a common line here")]


def test_lines_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "n", 1) for r in LINES], "doc_id long, text string, gone string, h1 int")
    for hot, least, probes in ((20_000, 10_000, 250_000), (3, 2, 250_000), (20_000, 10_000, 1), (20_000, 4, 2)):
        for name, value in (("HOT_SHARE", hot), ("HOT_LEAST", least), ("SHARD_PROBES", probes)):
            monkeypatch.setattr(lines, name, value)
        got = lines.dedup_lines(docs).collect()
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(LINES)
    for most, probes in ((1, 2), (2, 1), (3, 5)):  # few shards: all are copied, and some are busy
        for name, value in (("MAX_SHARDS", most), ("HOT_LEAST", 10_000), ("SHARD_PROBES", probes)):
            monkeypatch.setattr(lines, name, value)
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()) == brute_lines(LINES)
    kept = lines.dedup_lines(docs, keep_columns=True)
    assert kept.columns == docs.columns and {r.text for r in kept.where("doc_id = 9").collect()} == {None}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        h1, h2 = r.integers(-(2**63), 2**63 - 1, n), np.arange(n)
        built = lines.PerfectHash.from_bytes(*lines.PerfectHash.build(h1, h2).to_bytes())
        assert sorted(built.places(h1, h2).tolist()) == list(range(n))


def test_lines_whose_first_64_bits_agree():
    import numpy as np

    h1, h2, counts, owners = (np.array(x, np.int64) for x in ([5, 5, 9, 5], [1, 2, 1, -7], [2, 3, 4, 5], [10, 20, 30, 40]))
    shard = lines.Shard(lines._build(0, h1, h2, counts, owners))
    got, owner = shard.look_up(np.array([5, 5, 9, 5, 9, 4]), np.array([2, -7, 1, 1, 2, 1]))
    assert got.tolist() == [3, 5, 4, 2, 0, 0] and owner[:4].tolist() == [20, 40, 30, 10]


def test_minhash(spark):
    import hashlib

    rows = [r for r in ROWS if r[0] is not None][:-1]
    got = {r.doc_id: r for r in minhash.compare_with_edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(rows, key=lambda r: r[0], reverse=True)

    def jaccard(a, b):
        sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(re.split(r"[ \t\n\x0b\f\r]+", t.lower().strip(" \t\n\v\f\r"))) if t.strip(" \t\n\v\f\r") else set() for t in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0

    for (i, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(got[i].fingerprint) == 256 and abs(got[i].near_edited - jaccard(t, edited)) < 0.15 and abs(got[i].near_next - jaccard(t, n)) < 0.15
    assert got[19].fingerprint == got[22].fingerprint == "0" * 256
    repeated = minhash.compare_with_edited(spark.createDataFrame(ROWS, SCHEMA))
    assert repeated.count() == len(ROWS) and repeated.where("doc_id is null").count() == 1
    assert minhash.compare_with_edited(spark.createDataFrame([], SCHEMA)).count() == 0


def similar(a, b):
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(lower(t).split()) for t in (a, b)]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def kept_ids(spark, texts):
    return {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string")).select("doc_id").collect()}


def test_truncated_and_extended_copies_are_near_copies(spark):
    texts = {}
    for i in range(30):
        whole = words(400, 1000 + i)
        texts |= {10 * i: whole, 10 * i + 1: " ".join(whole.split()[: 400 - (40, 60, 76)[i % 3]]), 10 * i + 2: words(400, 2000 + i)}
        assert similar(texts[10 * i], texts[10 * i + 1])
    assert kept_ids(spark, texts) == {i for i in texts if i % 10 != 1}


def test_a_tail_of_new_words_keeps_a_near_copy(spark):
    few = words(200, 3).split()
    page = " ".join(random.Random(4).choices(few, k=1000))
    texts = {1: page, 2: page + " " + words(150, 5), 3: words(1000, 6)}
    assert similar(texts[1], texts[2]) and kept_ids(spark, texts) == {1, 3}


def test_an_unrelated_lesser_id_hides_no_near_copy(spark):
    texts = {0: words(400, 70)}
    for k in range(20):
        base = words(300, 300 + k)
        unrelated = " ".join(base.split()[:30]) + " " + words(270, 400 + k)  # meets both in many buckets, similar to neither
        texts |= {100 + k: unrelated, 1000 + 2 * k: base, 1001 + 2 * k: near(base, 1, k)}
        assert similar(base, texts[1001 + 2 * k]) and not similar(base, unrelated)
    assert kept_ids(spark, texts) == {i for i in texts if i < 1000 or i % 2 == 0}


def test_a_star_of_independent_edits_is_one_class(spark):
    base, at = words(200, 11), 500
    texts = {i: base if i == at else near(base, 4, 5000 + i) for i in range(1001)}
    texts = {i: t for i, t in texts.items() if similar(t, base)}
    assert len(texts) > 900 and not similar(texts[min(texts)], texts[max(texts)])
    assert kept_ids(spark, texts) == {min(texts)}


def test_near_copies_against_all_pairs(spark, monkeypatch):
    r = random.Random(12)
    texts = {}
    for g in range(6):
        chain = words(60 if g else 7, 600 + g)
        for i in range(25):
            texts[len(texts) * 7 % 1009] = chain
            chain = near(chain, r.randrange(3), r.randrange(10**6)) if r.random() < 0.8 else " ".join(chain.split()[r.randrange(4) :]) + " tail"
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if group[a] != group[b] and similar(texts[a], texts[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if x == old else x for i, x in group.items()}
    for rounds, common in ((2, 3), (0, 10**6)):
        monkeypatch.setattr(simhash, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(simhash, "COMMON_FROM", common)
        assert kept_ids(spark, texts) == {*group.values()}


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    one, other = words(100, 21), words(100, 22)
    rows = [(5, one), (5, other), (6, near(other, 1, 1)), (7, near(one, 1, 2)), (8, words(100, 23))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [5, 5, 8]

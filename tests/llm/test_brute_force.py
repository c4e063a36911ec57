"""Operators against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import ann, mixing, near_dup, packing, rules, secrets, toxicity, warc
from corvine.llm.common import run_folder, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(rng, families=12, size=14):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["X"], [own[k], "y"], [own[k].upper()]])
            out.append(" ".join(own))
    return out + ["", "one", "ONE", "two words"]


@pytest.mark.parametrize("small", [24, 3])
def test_components_equal_all_pairs(spark, monkeypatch, small):
    """Also where nearly all buckets are large, so that hubs and prefixes work."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    texts = near_copies(random.Random(4))
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert [got[k].component_id for k in range(len(texts))] == [root(k) for k in range(len(texts))]
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, "s", f"{one}\n{two}\n{one} {rest}"), (2, "s", f"{one} x"), (3, "s", f"{two} x"), (4, "s", f"{one.upper()} x")], "doc_id long, source string, text string")
    assert {r.doc_id: r.n_dup_lines for r in rules.quality_rules(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 3, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_texts_that_share_an_id_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(2, a, 1), (2, b, 2), (2, a, 3), (1, a, 4), (3, b, 5), (None, a, 6), (4, "", 7), (4, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    stay = sorted((str(r.doc_id), r.key) for r in near_dup.drop_near_duplicates(df).collect())
    assert stay == [("1", 4), ("2", 2), ("4", 7), ("4", 7), ("None", 6)]


def test_long_texts_are_read_in_slices(monkeypatch):
    text = " ".join(random.Random(1).choice(["aa", "Bb", "ccc", "é", "x\ny"]) for _ in range(3000)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole, slices = [], []
    h, first = near_dup.words.hashed(data, offs, True, whole)
    g, last = near_dup.words.hashed(data, offs, True, slices)
    monkeypatch.setattr(near_dup.words.slices, "__defaults__", (17,))
    g, last = near_dup.words.hashed(data, offs, True, slices)
    assert (h == g).all() and first.tolist() == last.tolist() and whole[0] == slices[0] == slices[1]


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        x = rng.integers(0, 2**63, 2000).astype(np.uint64)
        cut = int(2000 * share)
        a, b = np.unique(x), np.unique(np.concatenate((x[:cut], rng.integers(0, 2**63, 2000 - cut).astype(np.uint64))))
        mixed = [near_dup.words.mix(s) for s in (a, b)]
        ra, rb = near_dup.registers([np.sort(s) for s in mixed])
        j, _ = near_dup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))
        assert abs(j[0] - cut / (4000 - cut)) < 0.15


def played(rows, n_words):
    """What the schedule plays, step by step: for each document (index in rows) the
    words taken and its first slot; and the targets of sources."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(n for n, (_, t, _) in zip(n_words, rows, strict=True) if t == s) for s in sources}
    target, open_, left = {}, set(sources), 1.5 * sum(own.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * own[s]}
        for s in over or open_:
            target[s] = 2 * own[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    block = max(8, -(-int(sum(target.values())) // 2**20))
    blocks = {s: -(-round(target[s]) // block) for s in sources}
    ends = np.cumsum([blocks[s] for s in sources])
    stream = {s: [] for s in sources}  # the document of each word
    for e in (0, 1):
        order = sorted(range(len(rows)), key=lambda k: hashlib.md5(f"{rows[k][0]}:{e}:{hashlib.md5(rows[k][2].encode()).hexdigest()}".encode()).hexdigest())
        for k in order:
            stream[rows[k][1]] += [k] * n_words[k]
    taken, first, turn = [0] * len(rows), {}, dict.fromkeys(sources, 0)
    for slot in range(int(ends[-1])):
        point = slot * mixing._PHI % 2**62 / 2**62
        s = sources[int(np.searchsorted(ends, int(point * int(ends[-1])), "right"))]
        for k in stream[s][turn[s] * block : (turn[s] + 1) * block]:
            taken[k] += 1
            first.setdefault(k, slot)
        turn[s] += 1
    return taken, first, target, block


def test_mix_is_what_the_schedule_plays(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "c", None]), " ".join(["w"] * rng.randint(0, 60))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, first, target, block = played(rows, [len(t.split()) for _, _, t in rows])
    pieces, stats, _, _ = mixing.mix(written(mixing.sized(df), "t"))
    got = {r.doc_id: (r.t, r.s) for r in pieces.groupBy("doc_id").agg(F.sum("words").alias("t"), F.min("slot").alias("s")).collect()}
    assert got == {k: (taken[k], s) for k, s in first.items()}
    assert all(taken[k] <= 2 * len(rows[k][2].split()) for k in range(len(rows)))
    for r in stats.collect():
        s = None if r.key == "~" else r.key[1:]
        assert abs(r.target - target[s]) < 1e-6 and r.target <= 2 * r.source_size
        assert abs(sum(t for t, (_, u, _) in zip(taken, rows, strict=True) if u == s) - r.target) <= 4 * block
    texts = mixing.mixed_documents(df.withColumn("n_chars", F.lit(0))).collect()
    assert sum(len(WORD.findall(r.text)) for r in texts) == sum(taken)
    seen = list(dict.fromkeys(r.doc_id for r in texts))
    assert [first[k] for k in seen] == sorted(first.values())  # in the order of the schedule


@pytest.mark.parametrize("partition", [700, 5000, 10**9])
def test_packing_holds_every_id_once(spark, partition):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = ["Hello", "world's", "naïve", "ΑΣ", "x1y2", "...", "日本", "İstanbul", "áb", "<|endoftext|>", "don't!", "Ünïcode.", "\x1c"]
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = packing.packed_digest(packing.pack(df, packing.default_tokenizer(), partition_tokens=partition)).collect()
    full = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, _, text in rows:
        ids, at = full.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert len(by_seq) <= sum(len(x) for x in []) + sum(r.length for r in got) // 2048 + 11


def test_windows_hold_target_proportions():
    totals = {"a": 200_000, "b": 100_000, "c": 20_000}
    queues = {q: [[n]] for q, n in totals.items()}
    seen = defaultdict(lambda: defaultdict(int))
    names = {id(v[0]): q for q, v in queues.items()}
    for item, _, n, seq, _ in packing.round_robin(queues, totals, 0, 1, 128):
        seen[seq][names[id(item)]] += n
    for seq in range(320_000 // 2048):
        for q, n in totals.items():
            assert abs(seen[seq][q] - 2048 * n / 320_000) <= 2 * 128 + 2


@pytest.mark.parametrize("partition", [3_000, 1_000_000])
def test_windows_hold_given_weights(spark, partition):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", "d", None]), " ".join(["word"] * rng.randint(0, 900))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"a": 3.0, "b": 1.0, None: 0.5}
    source = {k: q if q in weights else "*" for k, q, _ in rows}
    total = defaultdict(int)
    for k, _, text in rows:
        total[source[k]] += len(text.split()) + 1
    got = packing.pack(df, packing.default_tokenizer(), partition_tokens=partition, weights=weights, rest=0.5).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length))
    for k, _, text in rows:
        at = 0
        for start, n in sorted(by_doc[k]):
            assert start == at
            at += n
        assert at == len(text.split()) + 1
    share, given, left = {**weights, "*": 0.5}, defaultdict(int), dict(total)
    windows = defaultdict(lambda: defaultdict(int))
    for r in got:
        windows[r.sequence_id][source[r.doc_id]] += r.length
    checked = 0
    for seq in sorted(windows):
        assert sum(windows[seq].values()) == 2048 or seq >= sum(total.values()) // 2048
        open_ = [q for q in total if left[q] > 2048]
        if len(open_) == sum(left[q] > 0 for q in total) and sum(windows[seq].values()) == 2048:
            checked += 1
            for q in open_:
                assert abs(windows[seq][q] - 2048 * share[q] / sum(share[x] for x in open_)) <= 2 * 128 + 8
        for q, n in windows[seq].items():
            left[q] -= n
    assert checked >= 0.5 * len(windows) and not any(left.values())


def test_rules_equal_counting(spark):
    rng = random.Random(6)
    texts = [None, "", " \n "] + ["".join(rng.choice(["a ", "b ", "cc ", "é\n", "# ", "a b a b a b a b a b ", "\n\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    for r in rules.quality_rules(df).collect():
        t = texts[r.doc_id] or ""
        w, seen, cover, lines = WORD.findall(t), defaultdict(list), set(), [x for x in t.split("\n") if WORD.search(x)]
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for at in seen.values():
            if len(at) > 1:
                cover.update(x + j for x in at for j in range(8))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def test_secrets_by_structure():
    import base64
    import json

    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(json.dumps({'sub': 1}).encode())}.c2ln"
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
    der = lambda tag, x: bytes([tag, len(x)]) + x if len(x) < 128 else bytes([tag, 0x81, len(x)]) + x
    ec = der(0x30, der(2, b"\x01") + der(4, bytes(range(32))) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.scan(t)]
    assert kinds(f"é {jwt} x") == ["jwt"] and kinds(f"{jwt[:10]}.x.y") == []
    assert kinds(f"key {ssh} end") == ["ssh_key"] and kinds(f"key {ssh[:-4]} end") == []
    assert kinds(base64.b64encode(ec).decode()) == ["der_key"] and kinds(base64.b64encode(ec[:-1] + b"\0\0").decode()) == []
    assert "der_key" in kinds(ec.hex())
    assert kinds("PASSWORD: 'abcdef' ſecret=abcdef token: 'token'='abcdef'") == ["assign"]
    assert kinds("AKIA" + "B" * 15) == [] and kinds("xAKIA" + "B" * 16) == ["access"] and kinds("0" * 23 + "g" + "f" * 24) == ["hex"]


def test_warc_is_the_same_again(spark):
    rng = random.Random(8)
    pages = [(k, f"http://h/{k}", rng.choice(["same", "x" * k, "é" * k])) for k in range(1, 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    runs = []
    for parts in (1, 5):
        folder = run_folder(spark, "t")
        m = warc.write_warc(df.repartition(parts), folder, shard_bytes=2000, file_bytes=4000)
        runs.append(sorted((r.name, r.sha1, r.records) for r in m.collect()))
        rows = warc.read_warc(spark, folder).collect()
    assert runs[0] == runs[1] and len(runs[0]) > 3
    first = {}
    for k, _, html in pages:
        first.setdefault(html, k)
    by_id = {k: html for k, _, html in pages}
    for r in rows:
        html = by_id[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), warc.base32_sha1(html.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))


@pytest.mark.parametrize("shard_bytes", [1, 40, 10**9])
def test_warc_loses_no_repeated_row(spark, shard_bytes):
    rows = [(1, "u", "x" * 30), (1, "u", "x" * 30), (2, "u", "y"), (2, "u", "y"), (2, "v", "y"), (2, "u", "x" * 30), (-5, "u", None), (None, "u", "y"), (None, "u", "z"), (None, "u", "z")]
    folder = run_folder(spark, "t")
    warc.write_warc(spark.createDataFrame(rows, "page_id int, url string, html string"), folder, shard_bytes=shard_bytes)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect()), key=str)
    first = {"x" * 30: 1, "y": 2, None: -5, "z": None}
    want = []
    for k, _, html in rows:
        again = first[html] is not None and k is not None and k != first[html]
        want.append((k, len(html or ""), "revisit" if again else "response", first[html] if again else None))
    assert got == sorted(want, key=str)


def test_neighbours_recall(spark):
    x = np.random.default_rng(5).normal(size=(1500, 12)) * np.random.default_rng(6).uniform(0.5, 2, (1500, 1))
    x[700:760] = x[700]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_values=400 * 12).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hits >= 0.9 * 20 * 75


def test_automaton_equals_edit_distance():
    terms = ["stupid", "idiot", "trash", "worthless", "ok"]
    trie, rng = toxicity.Trie(terms), random.Random(1)

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
        return d[-1]

    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "s"])
        w = "".join(w)
        e, t = min((distance(w, t), t) for t in terms if len(t) > 4 or t == w)
        assert trie.match(w) == ((t, e) if e <= 1 else None)


def test_quotation_is_told_from_abuse():
    model = toxicity.Lexicon({"stupid": 4.0, "idiot": 4.0})
    plain, quoted = model.features("you stupid stupid idiot"), model.features('the note had "stupid idiot" in it')
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0
    assert model.features("a stuppid idjot")[1] > 0

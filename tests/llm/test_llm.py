"""The training-data operators on hand-made rows with nulls, empty, repeated and clashing cases, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidebook.llm import chat, fingerprints, join, language, mixing, packing, quality, repeats, site, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and", "der"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if k % 7 == 0 and texts:
            t = (rng.choice(texts) or "a").split()
            if k % 2 and len(t) > 60:
                t[rng.randrange(len(t))] = "changed"
        if k % 5 == 0:
            t += passage.split()
        texts.append(" ".join(t))
    texts += [None, "", "one", "Two words", "\t\n ", "é" * 60, texts[3], "x" * 3000, "ab " * 900]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.packed(none).count() == 0
    assert join.classes(none).count() == 0
    assert repeats.removed(none).count() == 0
    assert quality.judged(none).count() == 0
    assert fingerprints.compared(none).count() == 0
    assert mixing.mixture(none)[0].count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_join(docs):
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows(join.classes(docs))
    assert {i: (r.n, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}


def test_join_repeated_ids(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    data = []
    for k in range(30):  # each id has several texts; one of them is like another id's
        like = say(60)
        own = [say(60), say(61), like, say(62), say(40)]
        rng.shuffle(own)
        data += [(k, t) for t in own] + [(1000 + k, like + " changed"), (1000 + k, say(60))]
    data += [(5, data[0][1]), (6, None), (6, "")]
    sets = [shingles(t) for _, t in data]
    root = [*range(len(data))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for i, (d, _) in enumerate(data):
        least[find(i)] = min(d, least.get(find(i), d))
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = join.classes(d).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(data, sets)))


def test_repeats(docs):
    seen, want = {}, {}
    for i, text, *_ in corpus():
        b = (text or "").encode()
        covered, own = bytearray(len(b)), []
        for k in range(len(b) - 49):
            if seen.get(b[k : k + 50], i) < i:
                covered[k : k + 50] = b"\x01" * 50
            own.append(b[k : k + 50])
        for w in own:
            seen.setdefault(w, i)
        kept = bytes(c for c, v in zip(b, covered) if not v)
        want[i] = (len(b), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows(repeats.removed(docs)).items()} == want


def test_same_strings_by_bytes_where_names_fall_together(monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choice("ab") for _ in range(70))
    contexts = [shared[k : k + 55] for k in (0, 5, 9)] + ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 85))) for _ in range(40)]
    raw = "".join(contexts).encode()
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    strings = [raw[i + k : i + k + 50] for i, n in zip(begin, size) for k in range(n - 49)]
    for weak in (False, True):  # a bad hash of 16 bytes puts unlike strings into one bucket
        if weak:
            monkeypatch.setattr(repeats, "gram_ids", lambda buf: np.zeros(len(buf) - 15, np.uint64))
        start, bucket = repeats.same_strings(raw, begin, size - 49)
        assert [raw[i : i + 50] for i in start] == strings
        for i, a in enumerate(strings):
            same = [j for j, b in enumerate(strings) if a == b]
            assert [j for j, b in enumerate(bucket) if bucket[i] >= 0 and b == bucket[i]] == (same if len(same) > 1 else [])


def test_repeats_with_text(spark):
    p = "größer als alles, was je am Ende der langen Straße geschah, sagte er überall"
    texts = [p + " one", "zwei " + p, "ü" * 30 + p[7:], "drei " + p[:60] + "é", None, "", "kurz", p + " one", p + " one"]
    data = [(i, t, f"x{i}", "clash") for i, t in enumerate(texts)] + [(None, p, "n", "clash"), (0, p + " one", "again", "clash"), (1, "ein anderer Text unter derselben Nummer, lang genug: " + p, "other", "clash")]
    d = spark.createDataFrame(data, "doc_id int, text string, tag string, n_removed_ string")
    got = {r.tag: r for r in repeats.removed(d, with_text=True).collect()}
    assert len(got) == len(data)
    plain = {r.tag: r for r in repeats.removed(d).collect()}
    for doc, text, tag, clash in data:
        b = (text or "").encode()
        earlier = {x[k : k + 50] for i, t, *_ in data if doc is not None and i is not None and i < doc for x in [(t or "").encode()] for k in range(len(x) - 49)}
        gone = {k + j for k in range(len(b) - 49) if b[k : k + 50] in earlier for j in range(50)}
        assert (plain[tag].doc_id, plain[tag].n_bytes, plain[tag].n_removed, plain[tag].kept_sha256) == (doc, len(b), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest())
        at, left = 0, ""
        for c in text or "":
            n = len(c.encode())
            left += "" if gone & set(range(at, at + n)) else c
            at += n
        assert (got[tag].text, got[tag].n_removed, got[tag].n_removed_) == (text and left, len(gone), clash)


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = {(int(a), int(lo), int(hi)) for _, base, h, row, an, lo_, hi_ in repeats.anchor_runs(buf, np.array([0, 5000])) for a, lo, hi in zip(h, lo_ + base, hi_ + base)}
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    parts = [(int(a), lo, hi) for _, base, h, row, an, lo_, hi_ in repeats.anchor_runs(buf, np.array([0, 5000])) for a, lo, hi in zip(h, lo_ + base, hi_ + base)]
    strings = lambda runs: {(a, s) for a, lo, hi in runs for s in range(int(lo), int(hi) + 1)}
    assert strings(whole) == strings(parts)


def test_mixing(docs):
    sizes, taken, sources = mixing.mixture(docs, block_words=16, shard_slots=64)
    s = sizes.collect()
    assert {r.doc_id: r.size for r in s} == {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    words = {r.key: r.w for r in taken.groupBy("key").agg({"length": "sum"}).withColumnRenamed("sum(length)", "w").collect()}
    assert all(words.get(r.key, 0) <= 3 * r.size for r in s)
    for src in sources.collect():
        got = sum(words.get(r.key, 0) for r in s if r.target == src.target and r.source_size == src.source_size)
        assert abs(got - src.target) <= 0.05 * src.target + 32
    again = {r.key: r.w for r in mixing.mixture(docs, block_words=16, shard_slots=64)[1].groupBy("key").agg({"length": "sum"}).withColumnRenamed("sum(length)", "w").collect()}
    assert again == words
    pieces = mixing.mixed_documents(docs, block_words=16, shard_slots=64)
    assert pieces.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in pieces.collect()) == sum(words.values())


def test_permutation_and_draws():
    for n in (1, 2, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    counts = np.array([100, 0, 37, 863])
    draws = [mixing.shard_draw(counts, 8, k, 3) for k in range(8)]
    assert (sum(d for d, _ in draws) == counts).all()
    assert (draws[3][1] == sum(d for d, _ in draws[:3])).all()


def test_draws_above_the_samplers_bound():
    rng, other = np.random.default_rng(3), np.random.default_rng(4)
    for good, bad, take in ((50, 80, 40), (1000, 3000, 700), (3, 9, 11), (0, 5, 2), (5, 0, 2), (7, 4, 11)):
        a, b = (np.array([f() for _ in range(4000)]) for f in (lambda: mixing.drawn_from(rng, good, bad, take, most=1), lambda: other.hypergeometric(good, bad, take)))
        assert a.min() >= max(0, take - bad) and a.max() <= min(good, take)
        assert abs(a.mean() - b.mean()) <= 5 * (b.std() + 1e-9) / 4000**0.5 * 1.5 and abs(a.std() - b.std()) <= 0.06 * b.std() + 1e-9
    big = mixing.drawn_from(rng, 3 * 10**11, 7 * 10**11, 5 * 10**11)
    assert abs(big - 1.5e11) < 10 * 229_129
    counts = np.array([100, 0, 37, 863])
    draws = [mixing.shard_draw(counts, 8, k, 3, most=10) for k in range(8)]
    assert (sum(d for d, _ in draws) == counts).all() and all(d.sum() == 125 for d, _ in draws)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    got: dict = {}
    for r in packing.packed(docs, length=256, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    used: dict = {}
    for i, text, *_ in corpus():
        parts = sorted(got[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts])
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length <= 256 for r in parts)
        assert all(r.length == 256 for r in parts[1:])
        for r in parts:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    bins: list[int] = []  # best fit, largest first
    for n in sorted((n for p in used.values() for _, n in p), reverse=True):
        k = max((k for k in range(len(bins)) if bins[k] + n <= 256), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(used) <= len(bins)


def test_packing_needs_no_more_than_best_fit():
    rng = np.random.default_rng(8)
    for scale in (900, 300, 1500):
        sizes = np.minimum(2047, rng.exponential(scale, 1500).astype(int) + 1)
        bins: list[int] = []
        for n in sorted(sizes.tolist(), reverse=True):
            k = max((k for k in range(len(bins)) if bins[k] + n <= 2048), key=lambda k: bins[k], default=None)
            if k is None:
                bins.append(n)
            else:
                bins[k] += n
        b, o, used = packing.best(sizes, 2048)
        assert used <= len(bins)
        for k in range(used):
            mine = np.flatnonzero(b == k)
            mine = mine[np.argsort(o[mine])]
            assert (o[mine] == np.cumsum(sizes[mine]) - sizes[mine]).all() and sizes[mine].sum() <= 2048


ADDED = ["<|endoftext|>", "one<|endoftext|>two", "a  <|endoftext|>  b\n", "<|endoftext|><|endoftext|>", "<|endoftext|", "x <|ENDOFTEXT|> y", "é" * 30 + "<|endoftext|>" + "w " * 300]


def test_packing_added_token(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    got: dict = {}
    for r in packing.packed(spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string"), length=64, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(ADDED):
        parts = sorted(got[i], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in parts)


TRAPS = [r"\### Assistant: </turn> ok", r"\\</turn>", "</turn>", "### User:", "a\\", "<|endoftext|>", "", "é\n\n</turn>\n", "\\" * 5 + "### x:"]


def test_escape_round_trip():
    for t in TRAPS:
        assert chat.unescape(chat.escape(t)) == t


def test_chat(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("user", TRAPS[0]), ("assistant", TRAPS[1]), (None, None), ("assistant", TRAPS[7]), ("a\nb", "x")])] + [(2, 0, "system", t) for t in TRAPS[:2]] + [(None, None, "assistant", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    own = [x for x in turns if x[0] == 1]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for *_, r, t in own).encode()).hexdigest()
    loss = "".join(t for *_, r, t in own if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 2 and got[None].loss_chars == 1


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.choice([-1.0, -1.0, 2.0, 3.0]) for _ in range(12)]
        at = [i for i, v in enumerate(x) if v > 0]

        def best(lo, hi):  # the maximal segments of x[lo:hi], by definition
            top = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if not top or top[0] <= 0:
                return []
            return best(lo, top[3]) + [(top[3], top[4] - 1, top[0])] + best(top[4], hi)

        assert sorted(s for *_, s in toxicity.segments(at, [x[i] for i in at], 1.0)) == sorted(s for *_, s in best(0, len(x)))


def test_segments_with_evidence_against():
    rng = random.Random(12)
    for _ in range(100):
        n = 14
        at = sorted(rng.sample(range(n), 9))
        own = [rng.choice([-2.0, -1.0, 1.5, 3.0]) for _ in at]
        x = [-0.5] * n
        for i, v in zip(at, own):
            x[i] = v

        def best(lo, hi):
            top = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            return best(lo, top[3]) + [(top[3], top[4] - 1, top[0])] + best(top[4], hi) if top and top[0] > 0 else []

        assert sorted(round(s, 9) for *_, s in toxicity.segments(at, own, 0.5)) == sorted(round(s, 9) for *_, s in best(0, n))


def test_segments_take_linear_time():
    import time

    began = time.time()
    toxicity.segments([*range(0, 1_600_000, 10)], [3.0] * 160_000, 0.35)
    assert time.time() - began < 5


def test_toxicity_by_brute_force(spark):
    import math

    rng = random.Random(13)
    base = [f"w{k}" for k in range(30)]
    data = [(i, " ".join(rng.choice(base) for _ in range(25)) + (" idiot idiots scum" if i % 3 == 0 else " kind" * (i % 2))) for i in range(150)] + [(3, "a repeated id with another text")]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model, fit = toxicity.fitted(d, lab)
    n, counts = [0, 0], {}
    for i, text in data:
        y = int(i % 3 == 0)
        n[y] += 1
        for f in {f for w in set(text.split()) for f in toxicity.features(w)}:
            counts.setdefault(f, [0, 0])[y] += 1
    want = {}
    for f, (c0, c1) in counts.items():
        share = (c0 + c1) / sum(n)
        a, b = c1 + toxicity.PRIOR * share, c0 + toxicity.PRIOR * share
        delta = math.log(a / (n[1] + toxicity.PRIOR - a + 1e-9)) - math.log(b / (n[0] + toxicity.PRIOR - b + 1e-9))
        odds = delta - math.copysign(toxicity.Z * math.sqrt(1 / a + 1 / b), delta)
        if (odds >= toxicity.LEAST and c1 >= 3) or (odds <= -toxicity.LEAST and delta <= 0 and c0 >= 3):
            want[f] = odds
    assert model.keys() == want.keys() and all(abs(model[f] - want[f]) < 1e-9 for f in want)
    got = {(r.doc_id, round(r.score, 9)) for r in toxicity.scored(d, model, fit).collect()}
    lam, log_k = fit["tail"]
    a, c = fit["curve"]
    for i, text in data:
        x = []
        for w in text.split():
            odds = [model[f] for f in toxicity.features(w) if f in model]
            s = max(odds, default=0.0)
            x.append(s if s > 0 else min(-toxicity.DRIFT, max(min(odds, default=0.0), -toxicity.AGAINST)))

        def best(lo, hi):
            top = max(((sum(x[j:k]), -(k - j), j, k) for j in range(lo, hi) for k in range(j + 1, hi + 1)), default=None)
            return best(lo, top[2]) + [top[0]] + best(top[3], hi) if top and top[0] > 0 else []

        e = sum(max(0.0, lam * s - log_k - math.log(len(x))) for s in best(0, len(x)))
        assert (i, round(1 / (1 + math.exp(-(a + c * math.log1p(e)))), 9)) in got


def test_toxicity(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    data = [(i, " ".join(rng.choice(base) for _ in range(40)) + (" idiot scum" if i % 3 == 0 else "")) for i in range(300)] + [(1000, None), (1001, "")]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    model, fit = toxicity.fitted(d.filter("doc_id < 200"), lab.filter("doc_id < 200"))
    got = rows(toxicity.scored(d, model, fit, with_passages=True))
    assert all((got[i].score >= 0.7) == (i % 3 == 0) for i in range(200, 300))
    assert got[1000].score == got[1001].score < 0.7
    assert got[201].passages[0].first_word == 40


def test_language(spark):
    rng = random.Random(4)
    say = {"aa": "abcab", "bb": "xyzxy"}
    data = [(i, " ".join("".join(rng.choice(say[k]) for _ in range(5)) for _ in range(20)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]] + [(900, None, "aa"), (901, "12 34", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = rows(language.identified(d, language.fitted(d.filter("doc_id < 150"))))
    assert all(got[i].lang_pred == k for i, _, k in data[150:200])
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert language.identified(d, language.fitted(d.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_language_by_brute_force(spark):
    rng = random.Random(14)
    say = {"aa": "abcab", "bb": "xyzxy", "cc": "klmno"}
    data = [(i, " ".join("".join(rng.choice(say[k]) for _ in range(5)) for _ in range(12)), k) for i in range(60) for k in [rng.choice([*say])]] + [(5, "abc again under a repeated id", "aa")] * 3
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fitted(d)
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identified(d, model).collect()}
    for i, text, _ in data:
        g = np.concatenate(language.grams(text))
        s = model["table"][g].astype(float).mean(axis=0)  # the mean of the n-grams' weights
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert any(x[:2] == (i, model["languages"][int(p.argmax())]) and abs(x[2] - p.max()) < 1e-4 for x in got)
    assert language.fitted(d, per_language=4)["table"].shape == model["table"].shape


def test_quality_base(docs):
    got = rows(quality.judged(docs))
    for i, text, *_ in corpus():
        w = WORD.findall(text or "")
        five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, f in enumerate(five) if five.count(f) > 1 for j in range(5)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (got[i].base_failed and got[i].kept)


def test_fingerprints(spark, docs):
    got = rows(fingerprints.compared(docs))
    text = {r[0]: r[1] or "" for r in corpus()}
    ids = sorted(text, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[nxt][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].next_sigs == got[nxt].sigs
    prints = fingerprints.compared(docs).select("doc_id", "sigs")
    classes: dict = {}
    for r in prints.collect():
        classes.setdefault(tuple(r.sigs), []).append(r.doc_id)
    reps = {min(v): set(k) for k, v in classes.items()}
    want = {(a, b) for a in reps for b in reps if a < b and 5 * len(reps[a] & reps[b]) >= 4 * len(reps[a] | reps[b])}
    assert {(r.a, r.b) for r in fingerprints.near_pairs(prints).collect()} == want


def test_fingerprints_of_repeated_rows(spark):
    data = [(1, "the quick fox")] * 3 + [(2, "a lazy dog ran"), (None, "x"), (None, "x"), (1, "other of it")]
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprints.compared(spark.createDataFrame(data, "doc_id long, text string")).collect())
    own = hashlib.sha256(b"the quithe qu").hexdigest()
    assert len(got) == 7 and sum(x == ("1", 13, own) for x in got) == 2  # each but the last of the like rows is followed by its like


def test_site(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        good = rng.random() < (0.9 if i % 2 else 0.3)
        data.append((i, " ".join(f"word{rng.randrange(500)}" for _ in range(50)) if good else "AA!! | " * 30, ["bad", "good"][i % 2] if i % 11 else None, "p", int(good)))
    d = spark.createDataFrame(data, "doc_id long, text string, host string, path string, quality int")
    lab = d.select("doc_id", "quality").filter("doc_id < 200")
    got = rows(site.posteriors(d.select("doc_id", "text", "host", "path"), lab, site.classifier(d, lab)))
    assert sum((got[r[0]].score >= 0.5) == bool(r[4]) for r in data[200:]) >= 97
    assert got[1].host_rate > got[2].host_rate
    assert len(got) == 300
    assert site.posteriors(d.select("doc_id", "text", "host", "path"), lab.limit(0), None).count() == 300


def test_site_by_brute_force(spark):
    import math

    rng = random.Random(15)
    data = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(30)) if rng.random() < 0.6 else "AA!! | " * 20, rng.choice(["h1", "h2", "h3", None]), rng.choice(["p", "q", None])) for i in range(120)] + [(7, None, "h9", "p"), (7, "", "h4", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, host string, path string")
    lab = spark.createDataFrame([(i, int("word" in data[i][1])) for i in range(60)] + [(2, None)], "doc_id long, quality int")
    model = site.classifier(d, lab)
    evidence = {(r.doc_id, r.host, r.path): (r.llr, r.p) for r in site.evidence(d, model).collect()}
    known = {i: float("word" in data[i][1]) for i in range(60)}
    count = {k: known.get(k[0], p) for k, (_, p) in evidence.items()}
    rows = [(i, h, p) for i, _, h, p in data]
    groups = lambda key: {g: (sum(1 for r in rows if key(r) == g), sum(count[r] for r in rows if key(r) == g)) for g in {key(r) for r in rows}}
    hosts, paths = groups(lambda r: r[1]), groups(lambda r: r[1:])
    rate = (sum(count[r] for r in rows) + 0.5) / (len(rows) + 1)

    def concentration(gs):
        gs = [(n, k, r) for n, k, r in gs if n > 1]
        spread, chance, once = sum(n * (k / n - r) ** 2 for n, k, r in gs), sum(n * r * (1 - r) for n, k, r in gs), sum(r * (1 - r) for n, k, r in gs)
        extra = (spread - once) / max(1e-12, chance - once)
        return min(site.CONCENTRATION[1], max(site.CONCENTRATION[0], 1 / extra - 1)) if extra > 0 else site.CONCENTRATION[1]

    m_host = concentration([(n, k, rate) for n, k in hosts.values()])
    shrunk = {h: (k + m_host * rate) / (n + m_host) for h, (n, k) in hosts.items()}
    m_path = concentration([(n, k, shrunk[g[0]]) for g, (n, k) in paths.items()])
    got = sorted((r.doc_id, round(r.host_rate, 9), round(r.path_rate, 9), round(r.score, 9)) for r in site.posteriors(d, lab, model).collect())
    want = []
    for r in rows:
        (hn, hk), (n, k), (llr, _) = hosts[r[1]], paths[r[1:]], evidence[r]
        h = (hk - count[r] + m_host * rate) / (hn - 1 + m_host)
        p = (k - count[r] + m_path * h) / (n - 1 + m_path)
        q = min(1 - 1e-6, max(1e-6, p))
        want.append((r[0], round(h, 9), round(p, 9), round(1 / (1 + math.exp(-(math.log(q / (1 - q)) + llr))), 9)))
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, sorted(want)) if any(abs(x - y) > 1e-6 for x, y in zip(a, b))] == []


def test_pipeline_by_brute_force(spark):
    """Each stage against plain Python (quality rules: against their SQL), on rows with nulls, copies, repeats and a clashing column."""
    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tidebook.llm import queries_quality

    data = [(i, t, lang, src, len(t) if t is not None else None, h) for i, t, lang, src, _, h in corpus(n=90)] + [(None, "a text under no number, kept as it is and told apart from all", "en", "a", 60, "x")]
    d = spark.createDataFrame(data, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        r = stage(spark, d, "")
        out[name] = r.collect()
        if name != "best-fit packing":
            assert r.columns == d.columns
        d = spark.createDataFrame(out[name], r.schema)
    assert len(stages) == 5
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([x for x in data if x[0] is not None], columns=["doc_id", "text", "lang", "source", "n_chars", "_h"]))
    keeps = {i for (i,) in con.sql("SELECT doc_id FROM (" + queries_quality.sql(what="doc_id, kept") + ") WHERE kept").fetchall()}
    first = out["quality rules"]
    assert {r.doc_id for r in first if r.doc_id is not None} - keeps == set() and len(keeps - {r.doc_id for r in first}) <= 1  # the row without a number shifts the references a little
    sets = {k: shingles(r.text) for k, r in enumerate(first)}
    root = {k: k for k in sets}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in sets:
        for b in sets:
            if a < b and first[a].doc_id is not None and first[b].doc_id is not None and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for k, r in enumerate(first):
        if r.doc_id is not None:
            least[find(k)] = min(r.doc_id, least.get(find(k), r.doc_id))
    second = out["n-gram jaccard join"]
    assert sorted(map(str, second)) == sorted(str(r) for k, r in enumerate(first) if r.doc_id is None or r.doc_id == least[find(k)])
    seen: dict = {}
    want = []
    for r in sorted(second, key=lambda r: (r.doc_id is None, r.doc_id)):
        b, gone = (r.text or "").encode(), set()
        for k in range(len(b) - 49):
            if r.doc_id is not None and seen.setdefault(b[k : k + 50], r.doc_id) < r.doc_id:
                gone |= set(range(k, k + 50))
        at, left = 0, ""
        for c in r.text or "":
            n = len(c.encode())
            left += "" if gone & set(range(at, at + n)) else c
            at += n
        want.append((r.doc_id, left if r.text is not None else None, len(left) if gone else r.n_chars))
    third = out["suffix-array dedup"]
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in third), key=str) == sorted(want, key=str)
    pieces, total = out["mixing to target weights"], sum(len(WORD.findall(r.text or "")) for r in third)
    texts: dict = {}
    for r in third:
        texts.setdefault(r.doc_id, []).append(r)
    for i, own in texts.items():
        got = [r for r in pieces if r.doc_id == i]
        assert all(any(p.text in (r.text or "") and (p.lang, p.source, p._h) == (r.lang, r.source, r._h) for r in own) and p.n_chars == len(p.text) for p in got)
        assert sum(len(WORD.findall(p.text)) for p in got) <= 3 * sum(len(WORD.findall(r.text or "")) for r in own)
    assert abs(sum(len(WORD.findall(p.text)) for p in pieces) - total) <= 0.05 * total + 256
    t = Tokenizer.from_file(packing.default_path())
    ids: dict = {}
    for p in pieces:
        ids.setdefault(p.doc_id, []).append([*t.encode(p.text, add_special_tokens=False).ids, 0])
    packed = out["best-fit packing"]
    assert sum(r.length for r in packed) == sum(len(x) for xs in ids.values() for x in xs)
    lengths = lambda rows: {i: sum(r.length for r in rows if r.doc_id == i) for i in ids}
    assert lengths(packed) == {i: sum(map(len, xs)) for i, xs in ids.items()}
    crcs = sorted(zlib.crc32(np.array(x[k : k + n], "<u4").tobytes()) for xs in ids.values() for x in xs for first_ in [len(x) % 2048 or min(len(x), 2048)] for k, n in [(0, first_)] + [(j, 2048) for j in range(first_, len(x), 2048)])
    assert sorted(r.ids_crc32 for r in packed) == crcs
    places: dict = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables_of_fitted_operators(spark):
    none = spark.createDataFrame([], DOCS)
    lab = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model, fit = toxicity.fitted(none, lab)
    assert toxicity.scored(none, model, fit).count() == 0
    assert site.posteriors(none.select("doc_id", "text", none.source.alias("host"), none.lang.alias("path")), lab, site.classifier(none, lab)).count() == 0
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    import corpus_pipeline

    d = none
    for _, stage in corpus_pipeline.STAGES:
        r = stage(spark, d, "")
        assert r.count() == 0
        d = spark.createDataFrame([], r.schema)

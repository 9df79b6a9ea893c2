"""The training-data operators against brute force, exact round trips and
edge rows: nulls, empty and very long texts, ties, repeats, empty tables,
extra columns with clashing names."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from probelab.llm import ctph, hyperminhash, hyperplanes, mixing, packing, pii, preferences, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size int, head string"


def table(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], None if t is None else len(t), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]


def near_copies(seed=1, groups=12, copies=9, length=120):
    rng, words, out = np.random.default_rng(seed), vocabulary(seed, 4000), []
    for _ in range(groups):
        base = list(rng.choice(words, length))
        for _ in range(copies):
            t = list(base)
            for i in rng.choice(length, rng.integers(0, 8), replace=False):
                t[i] = str(rng.choice(words))
            out.append(" ".join(t))
    return out


def brute_components(texts, n, threshold):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("n,threshold", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, n, threshold):
    texts = near_copies() + [None, "", "  \n", "one", "ONE", "one two", "w " * 20_000]
    got = {r[0]: tuple(r)[1:] for r in hyperminhash.near_duplicates(table(spark, texts), n, threshold).collect()}
    assert got == brute_components(texts, n, threshold)


def chain(seed=4, links=40, length=150):
    """Texts in which each is a near copy of the one before only, in mixed order."""
    rng, words = np.random.default_rng(seed), vocabulary(seed, 4000)
    t, out = list(rng.choice(words, length)), []
    for _ in range(links):
        out.append(" ".join(t))
        for i in rng.choice(length, 5, replace=False):
            t[i] = str(rng.choice(words))
    return [out[i] for i in rng.permutation(links)]


def test_members_far_from_the_head_are_linked(spark):
    texts = chain() + near_copies(seed=5, groups=2, copies=20)
    got = {r[0]: tuple(r)[1:] for r in hyperminhash.near_duplicates(table(spark, texts), 3, 80, rounds=1).collect()}
    assert got == brute_components(texts, 3, 80)


@pytest.mark.parametrize("threshold", [60, 80, 85])
def test_prefix_index_loses_no_link(spark, threshold):
    texts = chain() + near_copies(seed=6, groups=2, copies=12)
    sets = [set(hyperminhash.shingle_set(t, 3).tolist()) for t in texts]
    members = spark.createDataFrame([(i, [7], [7], i) for i in range(len(texts))], "id long, fars array<long>, opens array<long>, component long")
    got = {tuple(r) for r in hyperminhash._far_pairs(members, table(spark, texts).select("doc_id", "text"), 3, threshold).collect()}
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    assert linked <= got and len(got) < len(texts) * (len(texts) - 1) // 2
    apart = members.selectExpr("id", "if(id % 2 = 0, array(7L), array()) as fars", "array(id % 2 + 6) as opens", "component")
    assert all((a % 2, b % 2) in ((0, 1), (1, 0)) for a, b in hyperminhash._far_pairs(apart, table(spark, texts).select("doc_id", "text"), 3, threshold).collect())


def test_copies_of_one_text_have_it_as_their_head(spark, monkeypatch):
    rng, words, n = np.random.default_rng(9), vocabulary(9, 4000), 200
    base, texts = rng.choice(words, 120), []
    for _ in range(n):
        t = base.copy()
        t[rng.choice(120, 4, replace=False)] = rng.choice(words, 4)
        texts.append(" ".join(t))
    texts.append(" ".join(base))            # the largest id
    pairs = []

    def compared(members, *_):
        pairs.extend(tuple(r) for r in members.select("a", "b").collect())
        raise InterruptedError
    monkeypatch.setattr(hyperminhash, "_compared", compared)
    with pytest.raises(InterruptedError):
        hyperminhash.near_duplicates(table(spark, texts), 5, 80)
    assert len({b for a, b in pairs if a == n}) > 0.98 * n, len(pairs)
    assert len(pairs) < 5 * n


def test_near_duplicates_of_nothing(spark):
    assert hyperminhash.near_duplicates(table(spark, [])).count() == 0


def test_register_estimate_is_close():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.unique(np.r_[a[:1800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    e = hyperminhash.estimate(hyperminhash.sketch(np.unique(a))[None], hyperminhash.sketch(b)[None])[0]
    assert abs(e - 1800 / 2200) < 0.2


def test_targets_and_taken_words(spark):
    words = vocabulary(5, 300)
    rng = np.random.default_rng(5)
    sources = [None if i % 9 == 0 else ("s%d" % (i % 4)) for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(398)] + [None, ""]
    docs = table(spark, texts, sources)
    rows = mixing.mix_report(docs, block_words=500, shard_words=2000).collect()
    assert rows.__len__() == 400 and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs, block_words=500, shard_words=2000).collect()))
    names = sorted({s for s in sources if s is not None}) + [None]
    size = {s: sum(len(WORD.findall(t or "")) for t, x in zip(texts, sources) if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:     # reshare the excess until no source is above its bound
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        want = 2 * size[s] if s in full else level * weight[s]
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == size[s]
        assert abs(r.target - want) < 1e-6 and r.taken <= 2 * r.size
        taken[s] += r.taken
        size_of = want
    for r in rows:
        assert abs(taken[sources[r.doc_id]] - r.target) <= 20


def test_mix_shards_are_disjoint_and_whole(spark):
    docs = table(spark, ["a b c"] * 300, ["s%d" % (i % 3) for i in range(300)])
    m = mixing.mix(docs, block_words=30, shard_words=100).selectExpr("doc.doc_id as d", "shard", "epoch").collect()
    assert len({(r.d, r.epoch) for r in m}) == len(m) and len({r.shard for r in m}) > 4
    assert mixing.mix(table(spark, [])).count() == 0


def test_hypergeometric_mean(spark):
    from pyspark.sql import functions as F
    x = mixing.hypergeometric(F.lit(1000), F.lit(300), F.lit(500), mixing._uniform(F.col("id")))
    m, v, lo, hi = spark.range(4000).select(x.alias("x")).selectExpr("avg(x)", "var_samp(x)", "min(x)", "max(x)").first()
    assert abs(m - 150) < 1 and abs(v - 500 * .3 * .7 * 500 / 999) < 6 and 100 < lo < hi < 200


def test_preferences_split_at_the_first_difference(spark):
    s = "pair_id long, turn long, role string, text string"
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", None), (3, 0, "user", "z"), (None, 0, "user", "n"), (1, 0, "user", "q")], s)
    r = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, "user", "t"), (2, 0, "user", None)], s)
    got = {(x.pair_id, x.part, x.turn, x.loss): x.segment for x in preferences.format_preferences(c, r).collect()}
    assert got == {(1, "prompt", 0, False): "<|im_start|>user\nq<|im_end|>\n", (1, "chosen", 1, True): "<|im_start|>assistant\na<|im_end|>\n",
                   (1, "rejected", 1, True): "<|im_start|>assistant\nb<|im_end|>\n", (1, "rejected", 2, False): "<|im_start|>user\nt<|im_end|>\n",
                   (2, "prompt", 0, False): "<|im_start|>user\n<|im_end|>\n", (3, "chosen", 0, False): "<|im_start|>user\nz<|im_end|>\n"}


def test_fingerprints_match_plain_code(spark):
    texts = near_copies(2, 6, 4) + [None, "", "é", "x" * 5000, "ab"]
    got = {r[0]: tuple(r)[1:] for r in ctph.fingerprints(table(spark, texts), range_rows=4).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        f, g, n = map(ctph.fingerprint, (t, e, after))
        assert got[i] == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, ctph.likeness(f, g), ctph.likeness(f, n))
    assert ctph.likeness(ctph.fingerprint(texts[0]), ctph.fingerprint(texts[1])) > 0.5 > ctph.likeness(ctph.fingerprint(texts[0]), ctph.fingerprint(texts[5]))
    assert ctph.fingerprints(table(spark, [])).count() == 0


def test_packing_is_best_fit_under_conflicts(spark):
    rng = np.random.default_rng(7)
    pieces = [(int(rng.integers(1, 60)), (i,), f"s{rng.integers(3)}", int(rng.integers(40))) for i in range(300)]
    bins, plain = [], [None] * 300
    for i in sorted(range(300), key=lambda i: (-pieces[i][0], i)):
        size, _, source, cluster = pieces[i]
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), set()])
        bins[k][0] -= size
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        plain[i] = k
    assert packing.pack(pieces, 100, True) == plain


def test_packing_keeps_every_word(spark):
    texts = ["w " * n for n in (5, 5, 12, 31, 0, 9)] + [None]
    rows = packing.best_fit(table(spark, texts, list("aabbcca")), capacity=10).collect()
    words = defaultdict(int)
    for r in rows:
        words[r.doc_id] += r.n_words
        assert (r.bin is None) == (r.n_words == 0) and r.n_words <= 10
    assert dict(words) == {0: 5, 1: 5, 2: 12, 3: 31, 4: 0, 5: 9, 6: 0}
    both = {r.doc_id: (r.packing_group, r.bin) for r in rows if r.doc_id in (0, 1)}
    assert both[0] != both[1]       # equal texts
    assert packing.best_fit(table(spark, [])).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900
    pages = [(1, "u\r\nv", big), (2, None, big), (3, "w", "short"), (4, "w", "short"), (5, "x", None), (6, "y", ""), (None, "z", big)]
    folder, manifest = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), archive_bytes=2000)
    rows = {r.page_id: r for r in warc.read_archives(folder, manifest).collect()}
    for page_id, _, html in pages:
        raw, r = (html or "").encode(), rows[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(*empty).count() == 0


def test_base_spans_match_the_patterns():
    parts = ["a.b@c.de", "@x.y", "a@b", "a@b.c@d.ef", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+12", "4111 1111 1111 1111",
             "4111111111111112", " ", "x", "-", "1"]
    rng = np.random.default_rng(11)
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(400):
        t = "".join(rng.choice(parts, 8))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.identifiers(t) == want


@pytest.mark.parametrize("text,kind,found", [
    ("mail jo (at) site [dot] org now", "email", "jo (at) site [dot] org"), ("write jo at site dot org now", "email", "jo at site dot org"),
    ("jо@sitе.org!", "email", "jо@sitе.org"), ("call +four four two zero one two three four five six.", "phone", None),
    ("ip １０.0.0.1 here", "ip", "１０.0.0.1"), ("we met at one dot on the map", None, None), ("one of two cats", None, None)])
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = pii.added(text, pii.identifiers(text))
    assert [k for k, _, _ in spans] == ([kind] if kind else [])
    if found:
        assert text[spans[0][1]:spans[0][2]] == found


@pytest.mark.parametrize("text,whole,redacted", [
    ("to jоhn@site.org now", "jоhn@site.org", "to <EMAIL> now"), ("to jo\u200bhn@site.org now", "jo\u200bhn@site.org", "to <EMAIL> now"),
    ("to a@mail.site.оrg now", "a@mail.site.оrg", "to <EMAIL> now"), ("call +44 20 7946 095 eight now", "+44 20 7946 095 eight", "call <PHONE> now"),
    ("tel plus trois trois un deux trois quatre cinq six sept huit.", "plus trois trois un deux trois quatre cinq six sept huit", "tel <PHONE>."),
    ("Tel plus vier neun acht null sieben sechs fünf vier drei.", "plus vier neun acht null sieben sechs fünf vier drei", "Tel <PHONE>."),
    ("tel más tres cuatro uno dos tres cuatro cinco seis siete.", "más tres cuatro uno dos tres cuatro cinco seis siete", "tel <PHONE>."),
    ("to jo at site dot it.", "jo at site dot it", "to <EMAIL>."), ("to jo arobase site point ch now", "jo arobase site point ch", "to <EMAIL> now"),
    ("un 4111–1111–1111–1111", "4111–1111–1111–1111", "un <CARD>"), ("look at a dot in the sky", None, "look at a dot in the sky")])
def test_partly_disguised_identifiers_are_whole(text, whole, redacted):
    base = pii.identifiers(text)
    spans = pii.added(text, base)
    assert [text[s:e] for _, s, e in spans] == ([whole] if whole else [])
    assert not set(base) & set(spans) and pii.redact_text(text) == redacted


def test_pii_rows_and_redaction(spark):
    docs = table(spark, [None, "", "a@b.cd x", "y" * 300_000])
    assert {r.doc_id: r.n_email for r in pii.find_pii(docs).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[0] is None and out[2] == "<EMAIL> x" and pii.redacted(docs).columns == docs.columns


def test_toxicity_held_out_and_counterfactual(spark):
    rng, words = np.random.default_rng(9), vocabulary(9, 200)
    toxic = [i % 4 == 0 for i in range(600)]
    texts = [" ".join([*rng.choice(words, 30), *(["vileword"] if y else []), *(["muslim"] if y or i % 5 == 0 else [])]) for i, y in enumerate(toxic)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.predicted for r in model.score(docs).collect()}
    assert np.mean([rows[i] == y for i, y in enumerate(toxic)]) > 0.97
    free = toxicity.fit(docs, labels, swap_weight=0.0)
    gap = lambda m: abs(np.subtract(*m.scores(["a muslim person", "a jewish person"])))
    assert gap(model) <= gap(free) + 1e-9
    assert toxicity.fit(docs, labels.where("toxic = 0")).scores([None, ""]) == pytest.approx([1e-6, 1e-6])


def brute_entropy(texts, teaching, order):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""
    pad = lambda t: b"\xff" * (order - 1) + t.encode() + b"\xfe"
    level = defaultdict(int)
    for t in teaching:
        b = pad(t)
        for i in range(order - 1, len(b)):
            level[b[i - order + 1:i + 1]] += 1
    models = {}
    for k in range(order, 0, -1):
        if k < order:
            nxt = defaultdict(int)
            for g in level:
                nxt[g[1:]] += 1
            level = nxt
        c = [sum(v == x for v in level.values()) for x in (1, 2, 3, 4)]
        models[k] = (dict(level), quality.discounts(*c))

    def p(g):
        if not g:
            return 1 / quality.VOCABULARY
        counts, d = models[len(g)]
        same = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, off = sum(same.values()), lambda n: d[min(n, 3) - 1]
        own = same.get(g, 0)
        return (own - off(own) if own else 0) / total + sum(map(off, same.values())) / total * p(g[1:])
    out = []
    for t in texts:
        b = pad(t)
        out.append(-np.mean([np.log(p(b[i - order + 1:i + 1])) for i in range(order - 1, len(b))]))
    return out


def test_perplexities_match_dictionaries(spark):
    texts = ["the cat sat", "the hat", "a cat", "zzz qqq", "", "the cat sat on the hat"]
    docs = table(spark, [*texts, None])
    scores = {r.doc_id: r for r in quality.perplexities(docs, docs.where("doc_id < 3").select("doc_id"), order=3, batch_bytes=20, shards=3).collect()}
    want = brute_entropy(texts, [texts[i] for i in range(3) if scores[i].teaches], 3)
    assert [scores[i].entropy for i in range(6)] == pytest.approx(want, rel=1e-5) and scores[6].entropy is None
    kept = {r.doc_id: r.kept for r in quality.classify(docs, docs.where("false").select("doc_id")).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 16)), 6, axis=0) + 0.08 * rng.standard_normal((240, 16))
    x[7] = x[6]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(240)] + [(240, None, 1), (241, [0.0] * 16, 1), (242, [1.0, None], 1), (243, [float("nan")] * 16, 1),
                                                                       (244, [1.0], None), (245, [], 2)]
    got = {r[0]: tuple(r)[1:] for r in hyperplanes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(240)[:, None] % 3 == np.arange(240) % 3) & ~np.eye(240, dtype=bool)
    component = np.arange(240)
    for _ in range(240):
        component = np.array([min([component[i], *component[link[i]]]) for i in range(240)])
    for i in range(240):
        assert got[i] == (link[i].sum(), component[i], component[i] == i)
    assert all(got[i] == (0, i, True) for i in range(240, 246))


def test_every_trusted_text_is_scored_unseen(spark):
    rng, words = np.random.default_rng(12), vocabulary(12, 60)
    texts = [" ".join(rng.choice(words, 12)) for _ in range(20)]
    docs = table(spark, [*texts, texts[0], "zzz qqq", None])
    trusted = docs.where("doc_id < 21 or doc_id = 22").select("doc_id")
    rows = docs.selectExpr("doc_id", f"pmod(xxhash64({quality.HELD}, text), {quality.HELD}) as fold").collect()
    fold = {r.doc_id: r.fold for r in rows}
    scores = {r.doc_id: r for r in quality.perplexities(docs, trusted, order=3, batch_bytes=200, shards=3).collect()}
    every = [*texts, texts[0]]
    assert [scores[i].entropy for i in range(22)] == pytest.approx(brute_entropy([*every, "zzz qqq"], every, 3), rel=1e-5)
    for i in range(21):     # by the model of all other folds; a copy shares its text's fold
        want = brute_entropy([every[i]], [t for j, t in enumerate(every) if fold[j] != fold[i]], 3)[0]
        assert scores[i].teaches and scores[i].unseen == pytest.approx(want, rel=1e-5)
    assert scores[21].unseen is None and scores[22].unseen is None and scores[22].entropy is None
    rows = {r.doc_id: r for r in quality.classify(docs, trusted, high=1.0, order=3).collect()}
    assert all(rows[i].kept for i in range(21)) and max(rows[i].level for i in range(21)) >= rows[0].upper - 1 / quality.STEPS


def test_pipeline_decides_each_row_by_its_own_text(spark, tmp_path):
    import corpus_pipeline
    rng, words = np.random.default_rng(13), vocabulary(13, 300)
    draw = lambda n: " ".join(rng.choice(words, n))
    texts = [draw(60) for _ in range(30)]
    copy, junk = draw(60), "7#% " * 60
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, copy), (None, copy), (None, copy), (None, draw(60)), (41, draw(60)), (41, draw(60)), (41, junk), (None, junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([*rows[:31], *rows[33:37]], key=str)       # the second junk row is a copy of the first
    good = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    found = [(r.doc_id, r.text) for r in good.collect()]
    assert junk not in [t for _, t in found] and sum(i == 41 for i, _ in found) >= 1

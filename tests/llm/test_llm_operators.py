"""The training-data operators against brute force, and on odd rows."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronokey.llm import html_text, mixing, mixing_lm, near_vectors, ngram_join, packing, prefix_forest, quality, sharding, token_counts

DIR = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, _h long, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 1, 7, "x"), (1, "a b c d e f", "en", "s", 1, 7, "x"), (2, None, None, None, None, None, None), (3, "", "en", None, 0, 1, "y"), (4, " \n\t", "de", "s", 3, 1, "y"), (None, "a b c d e f", "en", "t", 1, 1, "z"), (5, long, "en", "t", 1, 1, "z"), (6, long + " end", "en", "s", 1, 1, "z"), (7, "é ü   x", "fr", "s", 1, 1, "z")]
    return spark.createDataFrame(rows, ODD)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, num):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(10_000)
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    more = [(10_000 + i, " ".join(base[:k] + ["x"] * (i % 3))) for i, k in enumerate(range(1, 13))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {}
    for r in docs.collect():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, n, num).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()} and links


def test_blocks_agree():
    r = np.random.default_rng(1)
    for num, size in itertools.product((80, 90), (1, 5, 12, 40, 200, 1000)):
        b = ngram_join.Blocks(num, 100)
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            room = b.distance(len(a), len(a)) // 2
            cut = int(r.integers(0, room + 1))
            other = np.unique(np.concatenate([a[cut:], r.integers(0, 2**63, cut).astype(np.uint64)]))
            both = len(np.intersect1d(a, other))
            if 100 * both >= num * (len(a) + len(other) - both):
                assert np.intersect1d(b.keys(a), b.keys(other)).size


def test_odd_join(odd):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.link(odd, 3, 90).collect())
    assert got == [(0, 4, 1), (1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 29_998, 5), (6, 29_999, 5), (7, 2, 7)]
    assert sorted(r["doc_id"] or 0 for r in ngram_join.keep_one(odd, 3, 90).collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert ngram_join.link(odd.limit(0)).count() == 0


def test_keep_one_repeated_ids(spark):
    """Rows that share an id but not a text are judged by their own component; none is lost whole."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b + " end"), (11, c), (11, "q w e r t y u"), (11, None), (11, ""), (12, c), (7, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.keep_one(docs)
    want = [(3, a), (7, b), (7, c + " end"), (11, ""), (11, None), (11, "q w e r t y u")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want)) and got.columns == docs.columns


def test_sharding(spark, odd, tmp_path):
    for docs, k in ((spark.read.parquet(f"{DIR}/documents.parquet"), 5), (odd, 3), (odd.limit(0), 3)):
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
        tree, _ = sharding.build(docs, sharding.metadata(), size, F.struct("doc_id", "text"), shards=k)
        rows = docs.select(tree.shard().alias("shard"), size.alias("b")).collect()
        assert len(rows) == docs.count() and all(0 <= r["shard"] < k for r in rows)
    got = sharding.op1_kd_shards(spark, DIR, 8).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() - per.min() <= 2 * got["size"].max() and (got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s))))).all()
    text = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(zlib.crc32(text[i]) == c for i, c in zip(got.doc_id, got.text_crc32, strict=True))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 60_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()


def test_packing(spark, odd):
    lengths, counts = np.array([1, 2, 7, 8, 20, 21, 40]), np.array([5, 1, 3, 4, 2, 2, 1])
    for k in (1, 2, 3, 4):
        cost = lambda cut: sum(c * (min(b for b in cut if b >= n) - n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*c, 40)) for c in itertools.combinations(lengths[:-1].tolist(), k - 1))
        assert cost(packing.optimal_bounds(lengths, counts, k)) == best
    got = packing.op2_packing(spark, DIR).toPandas()
    assert len(got) == 200 and (got.n_tokens <= got.bucket_len).all()
    per = got.groupby(["bucket", "batch"]).agg(n=("doc_id", "count"), L=("bucket_len", "first"))
    assert ((per.n * per.L <= 16384) | (per.n == 1)).all()
    odd_rows = packing.pack(odd, budget=100)
    assert odd_rows.count() == 9 and packing.pack(odd.limit(0)).count() == 0


def test_packing_is_exact_beside_a_long_text(spark):
    """One very long row doesn't coarsen the bounds of the others."""
    r = np.random.default_rng(4)
    lengths = np.array([*r.integers(1, 400, 600), 1_000_000])
    docs = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, size long")
    got = packing.pack(docs, F.col("size"), buckets=5).toPandas()
    size, count = np.unique(lengths, return_counts=True)
    c = np.concatenate([[0], np.cumsum(count)])
    best = np.array([0, *[np.inf] * len(size)])
    for _ in range(5):
        best = np.array([0, *[min(best[i] + (c[j] - c[i]) * size[j - 1] for i in range(j)) for j in range(1, len(size) + 1)]])
    assert got.padding.sum() == best[-1] - lengths.sum() and got.padding.min() >= 0
    wide = np.arange(1, 6001)
    assert len(packing.optimal_bounds(wide, np.ones(6000, int), 16)) == 16


def test_mixing(spark, odd):
    got = mixing.op9_mix(spark, DIR).toPandas()
    share = got.groupby("source").agg(s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    level = np.array([i % 3 + 1.0 for i in range(len(share))])
    want, total = np.zeros(len(share)), share.s.sum()
    open_ = np.ones(len(share), bool)
    while True:
        want[open_] = (total - want[~open_].sum()) * level[open_] / level[open_].sum()
        over = open_ & (want > 3 * share.s.to_numpy() + 1e-9)
        if not over.any():
            break
        want[over] = 3 * share.s.to_numpy()[over]
        open_ &= ~over
    assert np.allclose(share.t, want) and (got.taken <= 3 * got["size"]).all()
    assert (share.k <= share.t + 1e-6).all() and (share.t - share.k <= got.groupby("source")["size"].max()).all()
    r = {(x["doc_id"], x["source"]): x for x in mixing.mix(odd.drop("size")).collect()}
    assert r[(2, None)]["taken"] == 0 and mixing.repeat(odd).columns == odd.columns and mixing.mix(odd.drop("size").limit(0)).count() == 0


def test_quality(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    none = quality.score(odd, labels.limit(0)).toPandas()
    assert len(none) == 9 and none.score.between(0, 1).all() and quality.score(odd.limit(0), labels).count() == 0
    y = quality.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0, 4.0]), np.ones(6))
    assert np.allclose(y, [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])


def test_language_model(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = mixing_lm.score(docs, 1 << 10, 16).toPandas().set_index("doc_id")
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in docs.collect()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert math.isclose(got.base_score[i], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert (got.n_tokens[i], got.n_known[i], got.train_tokens[i], got.held_out[i]) == (len(t), sum(c[x] > 0 for x in t), n, i not in set(train))
    assert (got.score < 0).all()
    assert mixing_lm.score(odd, 100, 12).count() == 9 and mixing_lm.score(odd.limit(0), 100, 12).count() == 0


def test_language_model_trees():
    """Each context's leaves have probabilities that add up to one, near what was counted."""
    counts = np.random.default_rng(0).poisson(np.outer([0.1, 3, 50, 0], 9.0 / np.arange(1, 42)))
    p = np.exp(mixing_lm.blend(counts + 0.001))
    assert np.allclose(p.sum(1), 1, atol=1e-4) and np.abs(p[2] - counts[2] / counts[2].sum()).max() < 0.05
    assert mixing_lm.blend(np.ones((3, 1))).shape == (3, 1)


def _letters(k, word):
    before = [256, 256]
    out = 0.0
    for c in [*word, 256]:
        slot = ((before[-1] * 257 + before[-2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
        out += float(k.letters[slot, c])
        before.append(c)
    return out


def test_language_model_against_brute_force(spark, monkeypatch):
    """Counts without the own text, decisions and words text by text, and the mixer token by token."""
    kept = {}
    real = mixing_lm.keep
    monkeypatch.setattr(mixing_lm, "keep", lambda df, name: kept.setdefault(name, real(df, name)))
    monkeypatch.setattr(mixing_lm, "release", lambda *df: None)
    monkeypatch.setattr(mixing_lm, "learn", lambda settled, f=mixing_lm.learn: kept.setdefault("learnt", f(settled)))
    coders = []
    monkeypatch.setattr(mixing_lm, "model", lambda *a, f=mixing_lm.model: coders.append(f(*a)) or coders[-1])
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.union(spark.createDataFrame([(9000, "a a a a b"), (9001, "a a b"), (9002, ""), (9003, None), (9004, "zzz qqqq")], "doc_id long, text string"))
    got = mixing_lm.score(docs, 300, 10).toPandas().set_index("doc_id")
    k = coders[0][0]
    says, start = kept["learnt"]
    texts = {r["doc_id"]: [b"<s>", *[w for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode()))], b"</s>"] for r in docs.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    one, two, three = (sum((Counter(tuple(t[j : j + n]) for j in range(1 if n == 1 else 0, len(t) - n + 1)) for i, t in texts.items() if i in train), Counter()) for n in (1, 2, 3))
    pads = sum((Counter({(b"<s>", *t[:2]): 1}) for i, t in texts.items() if i in train), Counter())
    three += pads
    from chronokey.llm.words import hashes, spans

    def leaf(w):
        if w == b"</s>":
            return k.end
        data, a, b, _ = spans([w.decode()])
        return int(k.word_ids(hashes(data, a, b))[0])

    size = lambda n, most: min(most, int(np.frexp(float(n))[1]))
    for i, t in texts.items():
        own = lambda n: Counter(tuple(t[j : j + n]) for j in range(len(t) - n + 1)) if i in train else Counter()  # noqa: E731, B023
        o2, o3 = own(2), own(3)
        if i in train:
            o3[(b"<s>", *t[:2])] += 1
        common, total, rows = mixing_lm.COMMON, 0.0, []
        ctx2 = 0
        for j in range(1, len(t)):
            g2, g3 = (t[j - 1], t[j]), (t[j - 2] if j > 1 else b"<s>", t[j - 1], t[j])
            n2, n3 = two[g2] - o2[g2], three[g3] - o3[g3]
            ctx1 = one[(t[j - 1],)] if j > 1 else len(train)
            w = leaf(t[j])
            b2 = ctx2 > 0 and n3 > 0
            b1 = not b2 and ctx1 > 0 and n2 > 0
            if b2 or b1:
                total += math.log(n3 / ctx2 if b2 else n2 / ctx1)
            else:
                total += float(k.leaves[common, w])
                if w == k.esc:
                    c = one[(t[j],)]
                    total += math.log((c or k.rare_types) / (k.rare + k.rare_types)) + (0 if c else _letters(k, t[j]))
            rows.append((size(ctx2, 15), size(math.sqrt(ctx1), 15), b2, b1, size(n3, 15)))
            ctx2 = n2
            common = w if w < mixing_lm.COMMON else common
        for order in range(2):
            weight, bias = start[order].astype(float).copy(), np.zeros(16)
            up = [(np.zeros((16, 3)), np.zeros((16, 3)), np.zeros(16), np.zeros(16))]
            history, run, limit = [], 0, 16
            for j, (s2, s1, b2, b1, level) in enumerate(rows):
                if j == limit:
                    gw, hw, gb, hb = up[-1]
                    weight += 0.5 * gw / (hw + 20)
                    bias += 0.7 * gb / (hb + 2)
                    up.append((np.zeros((16, 3)), np.zeros((16, 3)), np.zeros(16), np.zeros(16)))
                    limit += min(mixing_lm.LONGEST, limit)
                bit = b2 if order == 0 else b2 or b1
                if s2 > 0 if order == 0 else s1 > 0 and not b2:
                    past = sum(int(x) << n for n, x in enumerate(reversed(history[-8:])))
                    x = np.array([says[order, 0, s2 * 16 + s1], says[order, 1, past], says[order, 2, size(run, 15) * 16 + (rows[j - 1][4] if j else 0)]], float)
                    g = min(size(run, 15), 3) * 4 + min(s2, 3)
                    sign = 1 if bit else -1
                    q = 1 / (1 + math.exp(-min(12, max(-12, weight[g] @ x + bias[g])) * sign))
                    total += math.log(q)
                    gw, hw, gb, hb = up[-1]
                    gw[g] += sign * (1 - q) * x
                    hw[g] += q * (1 - q) * x * x
                    gb[g] += sign * (1 - q)
                    hb[g] += q * (1 - q)
                history.append(bit)
                run = run + 1 if bit else 0
        assert math.isclose(got.score[i], total / math.log(10), rel_tol=2e-4, abs_tol=2e-3), i
    assert got.score.sum() > got.base_score.sum()


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer, models

    v = token_counts.pieces()
    oracle = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    texts = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + ["a  b", "日本 <s> x▁y", "  ", "<0x0A>\n"]
    c = token_counts.Counter(v)
    assert [c.text(t)[0] for t in texts] == [len(oracle.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) for t in texts]
    tie = token_counts.Counter([("<unk>", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁", -1.0), ("ab", -1.0), ("▁ab", -2.0)])
    small = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁", -1.0), ("ab", -1.0), ("▁ab", -2.0)], unk_id=0, byte_fallback=False))
    assert tie.text("ab") == (len(small.encode("▁ab").ids), -2.0) == (1, -2.0)  # the longest last piece wins
    assert token_counts.counts(odd, v).count() == 9


def test_html(spark):
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.extract(r["html"]) == "\n".join(b for b in blocks if b)
    page = "<body><header>Site</header><div class='main-menu'><a href=x>Home</a></div><div id=content><h1>T &amp; U</h1><p>Long text of the story, with <a href=y>a link</a> and more words.<p>Second\n paragraph <i>in</i>line.<ul><li>one<li>two</ul></div><div class=comments><p>I disagree with this long story altogether.</div><form>Mail</form><footer>&copy;</footer>"
    assert html_text.extract(page) == "T & U\nLong text of the story, with a link and more words.\nSecond paragraph inline.\none\ntwo"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html><body></body></html>") == ""
    assert html_text.extract("just text <") == "just text <"
    rows = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>x</p>", 6)], "page_id long, url string, html string, text long")
    assert sorted(r["n_chars"] for r in html_text.texts(rows).collect()) == [0, 1]


@pytest.mark.parametrize("wrap", [("<div>", "</div>"), ("", "")])
def test_html_without_article_keeps_all_sections(wrap):
    parts = ["h" * 30, *[x * k for k in (300, 250, 120) for x in "abcde"]]
    sections = "".join(f"<div>{''.join(f'<p>{p}</p>' for p in parts[a : a + 5])}</div>" for a in (1, 6, 11))
    links = "".join(f"<li><a href=x>place {i}</a></li>" for i in range(8))
    page = f"<html><body>{wrap[0]}<h1>{parts[0]}</h1>loose<ul>{links}</ul>{sections}{wrap[1]}<footer>end</footer></body></html>"
    assert html_text.extract(page) == "\n".join([parts[0], "loose", *parts[1:]])
    outside = f"<body><h1>Title</h1><div>{sections}</div><div>{links}</div></body>"
    assert html_text.extract(outside) == "\n".join(["Title", *parts[1:]])


def test_html_attributes():
    """Values are not names, and a heading's wrapper is no page header."""
    text = "<p>Some words of the story.</p>"
    for attrs in ('style="overflow: hidden"', 'title="A hidden gem"', "data-x='a class=menu b'", 'class="article-header"', 'class="market-share-analysis legal-side"'):
        assert html_text.extract(f"<body><article><div {attrs}><h1>Title</h1></div>{text}</article></body>") == "Title\nSome words of the story."
    for attrs in ('style="overflow: hidden"', 'class="post-header"'):
        assert html_text.extract(f"<body><div {attrs}><article>{text}</article></div></body>") == "Some words of the story."
    for attrs in ("hidden", 'hidden=""', 'class="comments"', "class='x share-bar'", "class=share", 'id="advert"', 'class="social-share"', "class=related-posts", "class=post-share"):
        assert html_text.extract(f"<body><article>{text}<div {attrs}>Off</div></article></body>") == "Some words of the story."
    assert html_text.extract(f"<body><div class='site-header'>Off</div><div id=x>{text}</div></body>") == "Some words of the story."


def test_html_articles_and_comments():
    story = "<p>Some words of the long story here.</p>" * 5
    want = "\n".join(["T", *["Some words of the long story here."] * 5])
    for page in (
        f"<body><article><h1>T</h1>{story}</article><article class='comment'><p>I disagree with this whole story</p></article></body>",
        f"<body><main><h1>T</h1>{story}<article class=comment><p>I disagree with this whole story</p></article></main></body>",
        f'<body><div class="layout with-sidebar"><h1>T</h1>{story}</div></body>',
        f'<body><div class="entry has-comments"><h1>T</h1>{story}</div></body>',
        f'<body><div class="sidebar"><h1>T</h1>{story}</div><div class="comments"><p>No.</p></div></body>',
        f"<body><article class='teaser'><p>Short.</p></article><article><h1>T</h1>{story}</article></body>",
    ):
        assert html_text.extract(page).removeprefix("Short.\n") == want
    assert html_text.extract(f"<body><article><h1>T</h1>{story}<p class='legal'>Law words.</p></article></body>") == want + "\nLaw words."


def test_html_is_linear(spark):
    import time

    start = time.process_time()
    pages = ["<a " + '"x" ' * 10_000, '<div class="x y">' * 50_000 + "t", '<a ">" ' * 50_000, "<div>" * 20_000 + "</b>" * 50_000, "<a " * 100_000, "<ul><li>" * 30_000, "<article class=q>" * 30_000 + "x", "<!--" * 50_000]
    assert [html_text.extract(p)[:3] for p in pages[1:2]] == ["t"] and all(isinstance(html_text.extract(p), str) for p in pages)
    assert time.process_time() - start < 60
    rows = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert html_text.texts(rows).count() == 2 and html_text.texts(rows.limit(0)).count() == 0


def test_gapless(spark):
    from chronokey.llm.common import gapless

    r = np.random.default_rng(0)
    rows = [(int(g), None if v == 7 else int(v) if v < 60 else 1000, int(w)) for g, v, w in zip(r.integers(0, 3, 900), r.integers(0, 100, 900), r.integers(0, 5, 900), strict=True)]
    df = spark.createDataFrame(rows, "g int, _s long, _lead int")
    for per in (20, 10_000):  # the numbers are the same at every size
        got = gapless(df, ["g"], ["_s", "_lead"], "n", per).toPandas()
        seen = {}
        for g, x in got.groupby("g"):
            x = x.sort_values("n")
            assert x.n.tolist() == list(range(len(x))) and x["_s"].fillna(-1).is_monotonic_increasing
            seen[g] = list(zip(x["_s"].fillna(-1), x["_lead"], strict=True))
        assert per == 20 or seen == before  # noqa: F821
        before = seen  # noqa: F841


def test_clashing_columns(spark):
    """Callers' columns keep their values, whatever their names; only those named as an added one are replaced."""
    names = ["_h", "_size", "_source", "times", "upto", "part", "edge", "_copy", "taken", "source_size", "_row", "_slice", "_s", "_id", "_length", "_bucket", "batch"]
    docs = spark.createDataFrame([(i, f"w{i} " * (i + 3), "st"[i % 2], *[i * 100 + k for k in range(len(names))]) for i in range(12)], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    ok = lambda df, skip=(): all(r[n] == r["doc_id"] * 100 + k for r in df.collect() for k, n in enumerate(names) if n not in skip)
    assert ok(mixing.repeat(docs)) and ok(mixing.mix(docs), ("taken", "source_size")) and ok(packing.pack(docs), ("batch",)) and ok(ngram_join.keep_one(docs))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    good = quality.keep_good(docs.union(docs.where("doc_id = 3")), labels)
    assert ok(good) and good.columns == docs.columns


def vectors(spark, n=300):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 16))
    x[50:90] = x[50] + 0.01 * r.normal(size=(40, 16))
    x[90:95] = x[90]
    rows = [(i, [float(v) for v in np.float32(x[i])], 0) for i in range(n)]
    bad = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] * 8, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0], 0), (n + 5, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), np.float64(np.float32(x))


def test_near_vectors(spark):
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(306), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(df).collect()}
    links = [*near.sum(1).tolist(), *[0] * 6]
    assert got == {i: (links[i], want[i], want[i] == i) for i in range(306)}
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_large_shard(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "LARGE", 100)
    monkeypatch.setattr(near_vectors, "BLOCK", 60)
    test_near_vectors(spark)


def test_near_vectors_of_many_centres(spark, monkeypatch):
    """Vectors without clusters, with planted pairs near the limit, over 40 centres."""
    monkeypatch.setattr(near_vectors, "SHARD", 30)
    monkeypatch.setattr(near_vectors, "BLOCK", 200)
    r = np.random.default_rng(6)
    x = r.normal(size=(1200, 32))
    other = r.normal(size=(600, 32))
    other -= x[:600] * ((other * x[:600]).sum(1) / (x[:600] ** 2).sum(1))[:, None]
    other *= np.linalg.norm(x[:600], axis=1, keepdims=True) / np.linalg.norm(other, axis=1, keepdims=True)
    x[600:] = 0.91 * x[:600] + math.sqrt(1 - 0.91**2) * other
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = near_vectors.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    assert len(near_vectors.centres(u, 40)) >= 10 and near.sum() >= 1200
    assert (got.n_links == near.sum(1)).all() and (got.audit_recall == 1).all()
    want = components(range(1200), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert got.component_id.to_dict() == want


def test_prefix_forest(spark):
    df, x = vectors(spark)
    got = prefix_forest.search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id]) and mine.score.is_monotonic_decreasing
        hit += len(set(best) & set(mine.vec_id))
    assert hit >= 0.9 * 20 * 15 and set(got.query_id) == set(range(0, 300, 20))
    assert prefix_forest.search(df.limit(0), df.limit(0)).count() == 0


def test_prefix_forest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "ROWS", 40)
    monkeypatch.setattr(prefix_forest, "ASKED", 4)
    monkeypatch.setattr(prefix_forest, "BLOCK", 2)
    test_prefix_forest(spark)
    test_prefix_forest_of_repeated_ids(spark)


def test_prefix_forest_ranges():
    """Tallies and candidates against the common prefixes of all pairs; grouped vectors have few candidates."""
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(40, 16)), 25, 0) + 0.05 * r.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = prefix_forest.strings(x, prefix_forest.planes(16))
    w = h[::50]
    common = np.array([[[60 - (int(a) ^ int(b)).bit_length() for a, b in zip(i, j, strict=True)] for j in h] for i in w])
    counts = prefix_forest.tallies(h, w)
    assert all((counts[:, d] == (common >= d).sum((1, 2))).all() for d in range(61))
    order = np.argsort(h, axis=0, kind="stable")
    depth = np.array([8, 60] * 10)
    mask = prefix_forest.candidates(order, np.take_along_axis(h, order, 0), w, depth)
    assert (mask == (common.max(2) >= depth[:, None])).all()
    nearest = np.argsort(-(x[::50] @ x.T), axis=1)[:, :20]
    assert np.take_along_axis(mask[::2], nearest[::2], 1).mean() >= 0.99 and mask[::2].mean() < 0.2


@pytest.fixture(scope="module")
def mess(spark):
    """Repeated ids, nulls, near copies, a very long text and many lengths."""
    a, b, long = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 60), ("l", 30_000)))
    rows = [(3, a, "s"), (7, a + " end", "t"), (7, b, "s"), (7, b, "s"), (9, b + " end", None), (None, b, "s"), (None, None, "t"), (10, None, None), (10, "", "s"), (11, " \t", "s"), (12, long, "u"), (12, long + " end", "u"), (13, long + " more", "t")]
    rows += [(20 + k // 2, " ".join(f"r{k}x{i}" for i in range(3 * k + 1)), "stu"[k % 3]) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", src, len(t or "")) for i, t, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, rows


def test_pipeline_distinct(spark, mess):
    docs, rows = mess
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = components(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.distinct(spark, docs, DIR).collect())
    free = Counter(r for r, x in zip(rows, sets, strict=True) if r[0] is None or not x)
    assert all(got[r] == n for r, n in free.items())
    for c in set(comp.values()):
        some = [rows[i] for i in comp if comp[i] == c and sets[i] and rows[i][0] is not None]
        if some:
            assert sum(got[r] for r in set(some)) == 1 and sum(got[r] for r in set(some) if r[0] == min(some)[0]) == 1
    assert got.total() == free.total() + len({comp[i] for i in comp if sets[i] and rows[i][0] is not None})


def test_pipeline_mixed(spark, mess):
    docs, rows = mess
    size = [len(words(t)) for _, t, _ in rows]
    h = [int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    of = {x: sum(n for n, r in zip(size, rows, strict=True) if r[2] == x) for x in names}
    level = {x: k % 3 + 1.0 for k, x in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        room = sum(of.values()) - sum(target.values())
        share = {x: room * level[x] / sum(level[y] for y in open_) for x in open_}
        over = {x for x in open_ if share[x] > 3 * of[x]}
        target |= {x: 3.0 * of[x] for x in over} if over else share
        open_ -= over or open_
    want = Counter()
    for k, r in enumerate(rows):
        if not size[k]:
            continue
        times = math.floor(target[r[2]] / of[r[2]])
        rest = target[r[2]] - times * of[r[2]]
        before = sum(n for n, x, q in zip(size, h, rows, strict=True) if q[2] == r[2] and x < h[k])
        edge = sum(n for n, x, q in zip(size, h, rows, strict=True) if q[2] == r[2] and x == h[k])
        taken = size[k] * times + (size[k] if before + edge <= rest else size[k] * math.floor(rest - before) // edge if before <= rest else 0)
        want[r] += math.floor(taken / size[k] + 0.5)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mixed(spark, docs, DIR).collect())
    assert got == +want and got.total() > 20


def test_pipeline_packed(spark, mess):
    docs, rows = mess
    got = corpus_pipeline.packed(spark, docs, DIR).toPandas()
    lengths = [len(words(t)) for _, t, _ in rows]
    assert sorted(got.n_tokens) == sorted(lengths) and Counter(got.text.fillna("none")) == Counter("none" if t is None else t for _, t, _ in rows)
    size, count = np.unique(lengths, return_counts=True)
    c = np.concatenate([[0], np.cumsum(count)])
    best = np.array([0, *[np.inf] * len(size)])
    for _ in range(16):
        best = np.array([0, *[min(best[i] + (c[j] - c[i]) * size[j - 1] for i in range(j)) for j in range(1, len(size) + 1)]])
    assert len(size) > 16 and got.padding.sum() == best[-1] - sum(lengths) and (got.padding == got.bucket_len - got.n_tokens).all()
    for _, g in got.groupby("bucket"):
        room = max(1, 16384 // max(1, int(g.bucket_len.iloc[0])))
        assert sorted(zip(g.batch, g.batch_row, strict=True)) == [(i // room, i % room) for i in range(len(g))]
        assert g.sort_values(["batch", "batch_row"]).doc_id.fillna(-1).is_monotonic_increasing


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(got.doc_id) <= {r["doc_id"] for r in docs.collect()} and len(got)
    one = corpus_pipeline.distinct(spark, docs, DIR)
    assert one.columns == docs.columns and one.join(ngram_join.link(docs).where("doc_id = component_id").select("doc_id"), "doc_id").count() == one.count()
    assert corpus_pipeline.good(spark, docs, DIR).columns == docs.columns


def test_near_vectors_keep_to_their_disk(spark, monkeypatch):
    """Vectors without clusters over 80 centres, a group of near copies larger than a block, and pairs near the
    limit: kept tables stay in proportion to the input, and every link is there."""
    import os

    from chronokey.llm import common

    for name, value in (("SHARD", 30), ("LARGE", 100), ("BLOCK", 60), ("ROUND", 0), ("BUCKET", 60)):
        monkeypatch.setattr(near_vectors, name, value, raising=False)
    base = common.shared_dir(spark).removeprefix("file:")
    used = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(base) for f in files if f.endswith(".parquet"))
    most, write = [0], common.keep

    def keep(df, name):
        out = write(df, name)
        most.append(used())
        return out

    r = np.random.default_rng(9)
    x = r.normal(size=(2400, 32))
    other = r.normal(size=(300, 32))
    other -= x[:300] * ((other * x[:300]).sum(1) / (x[:300] ** 2).sum(1))[:, None]
    other *= np.linalg.norm(x[:300], axis=1, keepdims=True) / np.linalg.norm(other, axis=1, keepdims=True)
    x[300:600] = 0.905 * x[:300] + math.sqrt(1 - 0.905**2) * other
    x[600:800] = x[600] + 0.2 * r.normal(size=(200, 32))
    x = np.float64(np.float32(x))
    df = common.keep(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(2), "input")
    one = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(df.kept_at.removeprefix("file:")) for f in files if f.endswith(".parquet"))
    before = used()
    monkeypatch.setattr(near_vectors, "keep", keep)
    got = near_vectors.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    assert max(most) - before <= 4 * one
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[600:800, 600:800].sum() > 10_000 and near[:300, 300:600].sum() >= 300
    assert (got.n_links == near.sum(1)).all() and (got.audit_recall == 1).all()
    assert got.component_id.to_dict() == components(range(2400), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])


def repeats(spark):
    """Ids that repeat with other vectors, rows that repeat whole, and a column more; (id, vector) of each row."""
    r = np.random.default_rng(8)
    x = np.float64(np.float32(r.normal(size=(60, 8))))
    x[30:45] = np.float64(np.float32(x[:15] + 0.05 * r.normal(size=(15, 8))))
    ids = [*range(40), *[0] * 6, *[20, 40] * 7]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [rows[0], rows[0], rows[3], (100, rows[3][1]), (2, rows[5][1])]
    return spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, rep long"), rows


def test_near_vectors_of_repeated_ids(spark):
    df, rows = repeats(spark)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    of = components(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    low = {c: min(rows[i][0] for i in range(len(rows)) if of[i] == c) for c in set(of.values())}
    want = sorted((rows[i][0], int(near[i].sum()), low[of[i]], rows[i][0] == low[of[i]]) for i in range(len(rows)))
    assert sorted(tuple(r)[:4] for r in near_vectors.near_duplicates(df).collect()) == want


def test_prefix_forest_of_repeated_ids(spark):
    df, rows = repeats(spark)
    got = {}
    for r in prefix_forest.search(df, df.where("vec_id % 20 = 0"), 100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    each = {(i, tuple(v)) for i, v in rows}
    want = {}
    for i, v in each:
        if i % 20 == 0:
            found = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in each if (j, w) != (i, v))
            want.setdefault(i, []).extend((n + 1, j, -s + 0.0) for n, (s, j) in enumerate(found))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}

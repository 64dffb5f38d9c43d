"""Array kernels and data structures against brute force, without Spark."""

import base64
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import decontaminate, languages, lines, ngrams, packing, quality, rendering, secrets, simhash, tokens
from nearfield.llm.eliasfano import EliasFano
from nearfield.llm.kernels import words

TEXT = st.text(alphabet=st.sampled_from("abÄß 01.,\n\t-日é"), max_size=60)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes_are_those_of_single_words(texts):
    h, bound = words(texts)
    for k, t in enumerate(texts):
        found = re.findall(r"[^\W_]+", (t or "").lower())
        own = h[bound[k] : bound[k + 1]]
        assert len(own) == len(found)
        assert [words([w])[0][0] for w in found] == own.tolist()


@given(st.lists(TEXT, min_size=1, max_size=6), st.lists(TEXT, max_size=6))
@settings(max_examples=60, deadline=None)
def test_wu_manber_finds_what_substring_search_finds(patterns, texts):
    chars, breaks = decontaminate.normal_form([f" {t}" for t in patterns])
    begin = np.concatenate([[0], breaks[:-1] + 1])
    keep = breaks - begin >= 2
    if not keep.any():
        return
    begin, end = begin[keep], breaks[keep]
    wm = decontaminate.WuManber(chars, begin, end)
    text, _ = decontaminate.normal_form([f" {t}" for t in texts])
    got = sorted(zip(*(x.tolist() for x in wm.search(text, lane=7)), strict=True))
    whole = text.tobytes()
    want = []
    for p, (a, b) in enumerate(zip(begin, end, strict=True)):
        needle = chars[a:b].tobytes()
        want += [(at // 4, p) for at in range(0, len(whole), 4) if whole.startswith(needle, at)]
    assert got == sorted(want)


def test_bk_forest_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    code = np.concatenate([base, base[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))])
    code = code ^ (np.uint64(1) << rng.integers(0, 63, len(code)).astype(np.uint64))
    group = np.sort(rng.integers(0, 4, len(code)))
    got = {(int(a), int(b)) for q, n in simhash.BKForest(code, group).within(6) for a, b in zip(q, n, strict=True)}
    want = {(a, b) for a in range(len(code)) for b in range(a) if group[a] == group[b] and int(code[a] ^ code[b]).bit_count() <= 6}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("radius, bits, tables", [(12, 16, 4), (12, 6, 5), (3, 16, 4), (2, 16, 4), (12, 16, 1), (0, 16, 4)])
def test_close_pairs_are_all_pairs_within_the_radius(monkeypatch, radius, bits, tables):
    monkeypatch.setattr(simhash, "LEAST_BITS", 4)  # tables for few codes too
    rng = np.random.default_rng(5)
    left = rng.integers(0, 1 << 63, 700).astype(np.uint64) << np.uint64(1)
    right = np.concatenate([left[rng.integers(0, 700, 900)], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    for k in range(900):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            right[k] ^= np.uint64(1) << np.uint64(b)
    got = {(int(a), int(b)) for x, y in simhash.in_bulk(simhash.close_pairs(left, right, radius, bits, tables), 50) for a, b in zip(x, y, strict=True)}
    want = set(zip(*(x.tolist() for x in np.nonzero(simhash.distance(left[:, None], right) <= radius)), strict=True))
    assert got == want and want
    assert not list(simhash.close_pairs(left[:0], right, radius, bits, tables)) and not list(simhash.close_pairs(left, right[:0], radius, bits, tables))


def test_simhash_is_the_majority_of_each_bit():
    h = np.random.default_rng(2).integers(0, 1 << 63, 51).astype(np.uint64)
    want = sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h) > 51)
    got = simhash.simhash(np.concatenate([h, h[:9]]))
    assert bin(got).count("1") == bin(want).count("1") and sorted(simhash.simhash(h[:1]).to_bytes(8)) == sorted(int(h[0]).to_bytes(8))


@given(st.lists(st.integers(0, 10**6), max_size=700), st.integers(1, 10**6))
@settings(max_examples=40, deadline=None)
def test_elias_fano_round_trip(values, more):
    values = np.sort(np.array(values, np.int64))
    e = EliasFano.of(values, int(values[-1]) + more if len(values) else more)
    assert np.array_equal(e.all(), values)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(100, 900, 100_000))
    assert EliasFano.of(ends).nbytes < 1.6 * len(ends) < 8 * len(ends)


@pytest.fixture(scope="module")
def ranks():
    return open(tokens.TOKENIZER, "rb").read()


@given(TEXT)
@settings(max_examples=80, deadline=None)
def test_encoder_gives_the_tokenizers_ids(text):
    encode = _encoder()
    assert encode(text).tolist() == encode.encoding.encode_ordinary(text)


@pytest.mark.parametrize("blanks", [" " * 600, "\n" * 2000, "\t \n\u3000" * 300])
def test_long_blanks_are_encoded_as_short_ones_are(blanks):
    encode = _encoder()
    for text in (blanks, "a" + blanks, blanks + "b", f"a{blanks}b {blanks}.", f"x{blanks}\x1c{blanks}y"):
        assert encode(text).tolist() == encode.encoding.encode_ordinary(text)


def test_texts_of_any_kind_and_length_are_encoded():
    encode = _encoder()
    for text in ("\n" * 3_000_000, " " * 3_000_000 + "x", "ab" * 1_000_000, "?" * 2_000_000, "\r\n" * 1_000_000, "é" * 500_000):
        assert encode.encoding.decode(encode(text).tolist()) == text


_made = []


def _encoder():
    if not _made:
        _made.append(tokens.Encoder(open(tokens.TOKENIZER, "rb").read()))
    return _made[0]


def test_ranks_are_the_vocabulary(ranks):
    assert len({base64.b64decode(x.split()[0]) for x in ranks.splitlines()}) == 50256


def grams_of(text):
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        for n in (1, 2, 3):
            p = w if n == 1 else f" {w} "
            out |= {p[k : k + n] for k in range(len(p) - n + 1)}
    return out


def test_kernel_is_the_share_of_common_grams():
    landmarks, texts = ["Der Hund, die Katze", "the dog and the cat", "x"], ["die dogge", "", "日本", "the the cat", "a"]
    k, many = languages.Kernel(landmarks)(texts)
    known = set().union(*map(grams_of, landmarks))
    for i, t in enumerate(texts):
        own = grams_of(t)
        assert many[i] == len(own & known)
        for j, m in enumerate(landmarks):
            assert k[i, j] == pytest.approx(len(own & grams_of(m)) / math.sqrt(max(1, len(own)) * len(grams_of(m))), abs=1e-6)


def kneser_ney(texts, order):
    """Interpolated Kneser-Ney over bytes, by dictionaries: p(context, byte)."""
    counts = [Counter() for _ in range(order + 1)]
    seen = Counter([b"\0" * order])
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode()
        seen.update(raw[k : k + order] for k in range(len(raw) - order + 1))
    counts[order] = seen
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = []
    for k in range(1, order + 1):
        once, twice = sum(v == 1 for v in counts[k].values()), sum(v == 2 for v in counts[k].values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), Counter(g[:-1] for g in counts[k])
        for g, v in counts[k].items():
            total[g[:-1]] += v
        tables.append((counts[k], d, total, kinds))

    def p(context, byte):
        out = 1 / 256
        for k, (count, d, total, kinds) in enumerate(tables, 1):
            c = context[len(context) - k + 1 :] if k > 1 else b""
            if c in total:
                out = max(count[c + byte] - d, 0) / total[c] + d * kinds[c] / total[c] * out
        return out

    return p


def test_trie_scores_are_smoothed_probabilities(tmp_path):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "Ünïcödé", "", "the end"] * 2 + ["zebra"]
    order = 4
    p = kneser_ney(texts, order)
    keys, counts = ngrams.summed(np.concatenate([ngrams.grams(texts, order)[0], np.zeros(1, np.uint64)]))
    trie = ngrams.Trie.build(keys, counts, order)
    raw = tmp_path / "trie"
    raw.write_bytes(trie.to_bytes())
    mapped = ngrams.Trie.mapped(str(raw))
    probes = texts + ["the cow", "qqqq", "sat the dog é"]
    gram, bounds = ngrams.grams(probes, order)
    got, again = trie.log2p(gram), mapped.log2p(gram)
    assert np.array_equal(got, again)
    at = 0
    for t in probes:
        padded = b"\0" * (order - 1) + t.encode()
        for k in range(order - 1, len(padded)):
            assert got[at] == pytest.approx(math.log2(p(padded[k - order + 1 : k], padded[k : k + 1])), abs=0.2)
            at += 1
    assert at == bounds[-1]
    total = sum(p(b"the", bytes([b])) for b in range(256))
    assert total == pytest.approx(1)
    scorer = ngrams.Scorer(trie, bits=4)
    assert np.allclose(scorer(gram), got, atol=1e-5) and np.allclose(scorer(gram), got, atol=1e-5)


def test_lines_count_by_words_and_host():
    key, many, _, of = lines.line_keys(["A, b!\n\n a  B", None, "a b\r\nb a"], [1, 1, 2])
    assert many.tolist() == [2, 0, 2, 0, 2, 2] and of.tolist() == [0, 0, 0, 1, 2, 2]
    assert key[0] == key[2] != 0 and key[1] == 0 and key[4] not in (key[0], key[5])


def test_passages_cover_whole_texts():
    bags = quality.passages([" ".join(f"w{k}" for k in range(40)), "", None, "?!", "one"])
    assert np.bincount(bags.doc, minlength=5).tolist() == [3, 0, 0, 1, 1]
    assert np.diff(bags.at).tolist() == [16, 16, 8, 0, 1]


def test_gradients_of_the_attention_model():
    texts = ["good words here and there", "bad awful " * 20, "?!", "many more words in this longer text about nothing " * 5]
    model = quality.fitted(texts, {"quality": np.array([1, 0, 0, 1], np.float32), "toxic": np.array([0, 1, 0, 0], np.float32)}, epochs=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    bags, target = quality.passages(texts), {"quality": np.array([1.0, 0, 0, 1]), "toxic": np.array([0.0, 1, 0, 0])}
    weight = {k: np.ones(4) for k in target}

    def loss():
        first = np.flatnonzero(np.concatenate([[True], bags.doc[1:] != bags.doc[:-1]]))
        of = np.repeat(np.arange(4), np.diff(np.concatenate([first, [len(bags.doc)]])))
        h = model.encode(bags)[3]
        out = 0.0
        for k in quality.HEADS:
            y = model.attend(k, h, first, of)[4]
            out -= (target[k] * np.log(y) + (1 - target[k]) * np.log(1 - y)).mean()
        return out

    grad = model.step(bags, target, weight)
    rng = np.random.default_rng(0)
    for name in ("W", "b", "Vquality", "Utoxic", "wtoxic", "cquality", "dtoxic"):
        x = model.p[name]
        at = tuple(rng.integers(0, n) for n in x.shape)
        old, step = x[at], 1e-4
        x[at] = old + step
        up = loss()
        x[at] = old - step
        down = loss()
        x[at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        order = grid[np.argsort(packing.hilbert(grid, bits))]
        assert sorted(packing.hilbert(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_points_are_those_of_vectors_of_length_one():
    texts = ["same " * 400, "one two two", "", "?!", "one two two " * 50]
    v = packing.unit_points(texts, 3)
    for t, p in zip(texts, v, strict=True):
        n = Counter(t.split()) if t != "?!" else {}
        rows = {w: packing.directions(3)[int(words([w])[0][0] >> np.uint64(64 - packing.HASH_BITS))] for w in n}
        want = sum((c * rows[w] for w, c in n.items()), np.zeros(3)) / math.sqrt(max(1, sum(c * c for c in n.values())))
        assert p == pytest.approx(want, abs=1e-4)
    assert v[1] == pytest.approx(v[4], abs=1e-4)


def test_parts_count_the_bounds_before():
    rng = np.random.default_rng(1)
    bounds = np.unique(rng.integers(0, 6, (9, 2)), axis=0)
    key, doc = rng.integers(-1, 7, 200), rng.integers(-1, 7, 200)
    want = [sum((k, d) <= (a, b) for k, d in bounds.tolist()) for a, b in zip(key.tolist(), doc.tolist(), strict=True)]
    assert packing.part_of(key, doc, bounds).tolist() == want and packing.part_of(key, doc, bounds[:0]).tolist() == [0] * 200



def test_randomness_tests_accept_uniform_draws():
    rng = random.Random(3)
    t = secrets.Tokens(["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(400)])
    p = secrets.battery(t)
    assert (p > 0.05).mean(axis=0)[:3] == pytest.approx([0.95] * 3, abs=0.05)
    odd = secrets.battery(secrets.Tokens(["0123456789abcdef" * 4, "a1" * 20, "a" * 16]))
    assert odd[0, 3] < 0.01 and odd[1, 3] < 1e-6 and odd[2, 3] < 1e-6
    assert secrets.battery(secrets.Tokens([])).shape == (0, 4)


def test_threshold_is_benjamini_hochberg():
    rng = np.random.default_rng(0)
    for _ in range(50):
        bins = rng.integers(0, 400, 60)
        p = np.exp(-bins * secrets.LOG_WIDTH)
        order = np.sort(p)
        passed = np.flatnonzero(order <= 0.01 * np.arange(1, 61) / 60 * (1 + 1e-12))
        want = int((p <= order[passed[-1]]).sum()) if len(passed) else 0
        least = secrets.threshold(dict(Counter(bins.tolist())), 60, 0.01)
        assert int((bins >= least).sum()) == want


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ol><li>c<li value=7>d</ol></ul>x", "* a\n* b\n  1. c\n  7. d\n\nx"),
        ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><caption>T</caption><thead><tr><th>h<th>i</thead><tr><td colspan=2>wide cell<tr><td>1<td>2</table>", "T\nh  i\nwide cell\n1  2"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<head><title>t</title></head><body><h1>H</h1>text", "H\n\ntext"),
        ("<script>var a='<p>no</p>';</script>yes<style>p{}</style>", "yes"),
        ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<details><summary>s</summary>closed</details><details open><summary>s</summary>open</details>", "s\ns\nopen"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("a &amp; b &lt;c&gt; &eacute;&nbsp;x", "a & b <c> é x"),
        ("<!-- no --> a <!-- open", "a"),
        ("<b>x<p>y</b>z", "x\n\nyz"),
        ("a < b and c > d", "a < b and c > d"),
        ("<noscript>no</noscript><template>no</template><input type=submit value=Go><input type=hidden value=no>", "Go"),
        ("<h2>a<h3>b</h2>c", "a\n\nb\n\nc"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<textarea>&lt;b> x</textarea>", "<b> x"),
        ("<blockquote>q</blockquote>", "    q"),
        ("<p Hidden>a</p><p STYLE='DISPLAY:none'>b</p><p type=hidden>c</p>", "c"),
        ("E = <math><mi>m</mi><annotation>no</annotation></math>", "E = m"),
        ("a<svg><title>no</title><desc>no</desc><g><text>b</text></g></svg>c<object data=x>d</object>", "a b cd"),
        ("<a title='x > y'>in</a> <b title=\"open>out</b> '", "in out '"),
        ("<table><tr><td>" + "w" * 90 + "<td>b<tr><td>c<td>d</table>", "w" * 90 + "  b\nc" + " " * 91 + "d"),
        ("", ""),
    ],
)
def test_rendering(html, text):
    assert rendering.rendered(html) == text


class Visible(HTMLParser):
    """All text outside of hidden elements, in order."""

    def __init__(self):
        super().__init__()
        self.deep, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag in ("head", "script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.deep -= tag in ("head", "script", "style", "noscript", "template")

    def handle_data(self, data):
        if not self.deep:
            self.out += data.split()


def test_rendering_keeps_all_words():
    pq = pytest.importorskip("pyarrow.parquet")
    try:
        pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    except FileNotFoundError:
        pytest.skip("no test tables here")
    for html in pages:
        plain = Visible()
        plain.feed(html)
        got = [w for w in rendering.rendered(html).split() if w != "*"]
        assert "".join(got) == "".join(w for w in plain.out if w != "*")


@pytest.mark.parametrize("soup", ["<a ", '<a " ', "<a \">\" '", "<a x='\" y=\"'>", "<p>", "<div></x>", "<!-- ", "<table><tr><td>x", "<", "& ", " \n"])
def test_rendering_takes_time_in_proportion(soup):
    import time

    took = []
    for size in (200_000, 1_600_000):
        began = time.thread_time()
        rendering.rendered(soup * (size // len(soup)))
        took.append(time.thread_time() - began)
    assert took[1] < 30 * took[0] + 1  # eight times as long, not 64


def test_rendering_survives_anything():
    assert rendering.rendered(None) is None
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert rendering.rendered(deep) == "x"
    assert rendering.rendered("<table><tr><td>" * 2000 + "y") == "y"
    wide = rendering.rendered("<table>" + "<tr><td>" + "w" * 5000 + "<td>b" + "<tr><td>c<td>d" * 3000 + "</table>")
    assert len(wide) < 300_000 and "w  b" in wide and wide.endswith("c  d")
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td colspan=x>", "</table>", "<ul>", "<li>", "</ul>", "a b", "<", ">", "\"", "'", "<a href='", "<!--", "-->", "<pre>", "</", "&#0;", "&bogus;", "<script>", "</script>", "日本", "<head>"]
    for _ in range(300):
        rendering.rendered("".join(rng.choice(parts) for _ in range(60)))

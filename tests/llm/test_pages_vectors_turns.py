"""Main text of pages, vector codes and the prefix trie against brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillgrid.llm import html_extraction, prefix_trie, vector_codes
from tillgrid.llm.html_blocks import blocks_of

# --- op12 ---------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of usable rows, and the digest, by comparing everything with everything."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = [[int(np.floor(np.float64(c) * 1024)) for c in r[1]] for r in kept]
    size = len(x[0])
    parts = [[v[p * size // 4:(p + 1) * size // 4] for v in x] for p in range(4)]
    books = [[list(v) for v in part[:entries]] for part in parts]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            mine = [nearest(v, book)[1] for v in part]
            for i in range(len(book)):
                got = [v for v, m in zip(part, mine, strict=True) if m == i]
                if got:
                    book[i] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    found = [[nearest(v, book) for v in part] for part, book in zip(parts, books, strict=True)]
    error = [sum(f[i][0] for f in found) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{f[i][1]:02x}" for f in found), error[i], by_label[r[2]], sha) for i, r in enumerate(kept)), key=str)


def test_codes_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.integers(-3, 4, 8) / 7], int(i % 3) if i % 5 else None) for i in range(700)]
    rows += [(3, [0.5] * 8, 1), (3, [-0.5] * 8, 1), (None, [0.25] * 8, None), (701, None, 1), (702, [], 1), (703, [None] + [0.1] * 7, 1),
             (704, [float("nan")] + [0.1] * 7, 1), (705, [float("inf")] * 8, 1), (706, [0.0] * 6, 2)]
    table = spark.createDataFrame([(*x, "c", 1.5) for x in rows], "vec_id long, embedding array<float>, label int, code string, error double").repartition(7)
    got = sorted((tuple(x) for x in vector_codes.report(table).collect()), key=str)
    assert got == plain_codes(rows)


def test_few_odd_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.report(spark.createDataFrame([], schema)).collect() == []
    rows = [(7, [1.0, -1.0, 0.3], 1), (8, [1.0, -1.0, 0.3], 2)]  # fewer entries than 256, a size that 4 doesn't divide
    got = vector_codes.report(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in got] == [("00000000", 0, 0)] * 2
    assert vector_codes.report(spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1)], schema)).count() == 2


def test_slices_find_the_nearest(spark):
    r = np.random.default_rng(1)
    for size, k, spread in ((1, 256, 5), (16, 256, 400), (3, 70, 3), (5, 1, 9), (4, 64, 1 << 27)):
        book, x = r.integers(-spread, spread + 1, (k, size)), r.integers(-2 * spread, 2 * spread + 1, (300, size)).clip(-(1 << 27), 1 << 27)
        d2 = ((x[:, None] - book[None]) ** 2).sum(2)
        best, error = vector_codes.Slices(book).nearest(x)
        assert (best == d2.argmin(1)).all() and (error == d2.min(1)).all()


# --- op13 ---------------------------------------------------------------------------------


def plain_trie(rows):
    """The node rows of (conv_id, turn, role, text) rows."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    told = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(told.get(c - c % 100, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for path, conv in members.items():
        under = [p for p in members if p[:len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        leaf = [p for p in under if not any(q[:-1] == p and q for q in under)]
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(conv), len(path), min(members[path[:-1]]) if path else None, len(conv), len(kids), len(leaf),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), sha))
    return sorted(out, key=str)


def conversations_of(r):
    rows = []
    for c in (*range(0, 40), *range(100, 130), 305, 399):
        rows += [(c, t, ["user", "assistant", None][int(r.integers(3))], ["a", "bb", "ccc", None, "é", "ü𝄞"][int(r.integers(4 if t < 3 else 6))])
                 for t in range(int(r.integers(1, 9)))]
    rows += [(200, t, "user", "x") for t in range(40)] + [(201, t, "user", "x") for t in range(40)] + [(202, t, "user", "x") for t in range(44)]
    return rows + [(5, 1, "user", "a"), (5, 1, "user", "a"), (6, None, "user", "first"), (6, None, "user", "first"), (None, 1, "user", "none")]


@pytest.mark.parametrize(("segment", "shard"), [(64, 400_000), (3, 25)])
def test_trie_equals_brute_force(spark, segment, shard):
    rows = conversations_of(np.random.default_rng(3))
    table = spark.createDataFrame([(*x, 1, "g") for x in rows], "conv_id long, turn long, role string, text string, depth int, g string").repartition(5)
    got = sorted((tuple(x) for x in prefix_trie.trie(table, segment, shard).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_a_hot_conversation_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    long = spark.range(5000).select(F.lit(300).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = prefix_trie.trie(long).agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("n_leaves").alias("leaves"),
                                     F.sum("n_children").alias("children")).first()
    assert tuple(got) == (5001, 5000, 5001, 5000)
    turnless = [(c, 0, "user", "x") for c in range(1, 60)]  # no base conversation, one turn: many lose it
    got = sorted((tuple(x) for x in prefix_trie.trie(spark.createDataFrame(turnless, schema)).collect()), key=str)
    assert got == plain_trie(turnless)


# --- op11 ---------------------------------------------------------------------------------


def test_blocks():
    def texts(page):
        return [b.text for b in blocks_of(page)]
    assert texts(None) == texts("") == []
    assert texts("<p>a  b\n<b>c</b>d<br>e &amp; f&nbsp;g</p>") == ["a b cd", "e & f g"]
    assert texts("<script>var t='</p>';x</script><style>p{}</style><!-- <p>no --><p>yes<p>and<li>one<li>two") == ["yes", "and", "one", "two"]
    assert texts("1 < 2 <p title='a>b'>in</p> <p title='open>x</p><p>y</p>") == ["1 < 2", "in", "x", "y"]
    assert texts("<textarea>no") == [] and texts("a<!-- never closed") == ["a"]
    path = blocks_of('<div class="Main post" id=x1><p>a<p>b</div><p>c')
    assert [[e.tag for e in b.path] for b in path] == [["div", "p"], ["div", "p"], ["p"]] and path[0].path[0].names == ("main", "post", "x")
    assert [len(b.path) for b in blocks_of("<p><b>one" * 500)][-1] == 2


def test_gradients():
    r = np.random.default_rng(0)
    rows = [r.normal(size=(n, html_extraction.DIMS)) for n in (1, 3, 4)]
    labels = [r.integers(0, 2, len(x)).astype(float) for x in rows]
    net = html_extraction.Labeller.new(1)

    def loss():
        p = net.score([net.project(x) for x in rows])
        return -np.mean([np.log(q if y else 1 - q) for ps, ys in zip(p, labels, strict=True) for q, y in zip(ps, ys, strict=True)])
    got = net.gradients(rows, labels)
    for name, grad in got.items():
        at = tuple(int(r.integers(n)) for n in grad.shape)
        kept, e = net.params[name][at], 1e-5
        net.params[name][at] = kept + e
        up = loss()
        net.params[name][at] = kept - e
        down = loss()
        net.params[name][at] = kept
        assert abs((up - down) / (2 * e) - grad[at]) < 1e-6, name


def plain_article(page):
    """What stands in the article element of the test pages."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_articles_of_pages_not_learned_from(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = html_extraction.train(train)
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 250")
    got = {r["page_id"]: r for r in html_extraction.extract(rows, net).collect()}
    wrong = [r["page_id"] for r in rows.collect() if got[r["page_id"]]["text"] != plain_article(r["html"])]
    assert len(got) > 1000 and not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = html_extraction.train(pages)
    mains = [m for m in ([b.text for b in blocks_of(r["html"]) if any(e.tag == "article" for e in b.path)][:20] for r in pages.collect()) if m]
    layouts = html_extraction.Layouts(mains, 77)  # drawn with another seed than the training layouts
    made = [layouts.page(m) for m in mains]
    got = html_extraction.label(net, html_extraction.Vectors(), [b for b, _ in made])
    wrong = sum(int((a != b).sum()) for a, (_, b) in zip(got, made, strict=True))
    assert wrong / sum(len(b) for b, _ in made) < 0.01
    page = ("<html><body><div id='cookie'>We use cookies. <button>Accept</button></div><div class='menu'><a href=/>Home</a> <a href=/n>News</a></div><div class='post'>"
            "<h1>A title of it</h1><p>The first paragraph has a good many words in it, and ends.</p><p>So has the second one, which is no shorter than that.</p></div>"
            "<div class='comments'><p>Great post, thanks for it!</p><p>I don't agree.</p></div><form><label>Name</label></form><footer>&copy; 2024 us</footer></body></html>")
    blocks = blocks_of(page)
    kept = html_extraction.label(net, html_extraction.Vectors(), [blocks])[0]
    assert [b.text for b, k in zip(blocks, kept, strict=True) if k] == [b.text for b in blocks if any("post" in e.names for e in b.path)]


def test_pages_of_all_kinds(spark):
    net = html_extraction.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    long = "<article>" + "".join(f"<p>line number {i} of a very long page</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "no markup at all"), (4, "u", long), (4, "u", long), (5, "u", "<article><p>x" * 3000)]
    table = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extraction.extract(table, net).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] in (1, 2, None)] == ["", "", ""]
    assert {r["n_chars"] for r in got if r["page_id"] == 4} == {len(" ".join(f"line number {i} of a very long page" for i in range(20_000)))}
    empty = table.limit(0)
    assert html_extraction.extract(empty, html_extraction.train(empty)).collect() == []

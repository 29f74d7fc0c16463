"""The operators of the subpackage against brute force, round trips and held-out rows, with the odd cases."""

import hashlib
import random
import re
import string

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check_queries as CQ
import corpus_pipeline
from cohortspark.llm import extraction, lines, near, onebit, packing, pieces, queries, secret_scan, topk, toxicity, warc
from cohortspark.session import new_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, sig string, n int"  # two columns with names that the operators use inside
ODD = ["", None, " ", "\n\n", "a", "tok  en\n\n x", "ÀÉ ñ 日本 \x00\x1c  <s> <|endoftext|>", "word " * 30000, "x" * 50000]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "s", 1) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name, monkeypatch):
    monkeypatch.setattr(CQ, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(CQ, "ORACLES", queries.ORACLES)
    ok, text, _ = CQ.compare(spark, CQ.duck(sf), name, sf)
    assert ok, text


def test_pieces_match_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.round_trip(frame(spark, ODD), PIECES).collect()}
    ids = {r.doc_id: r.ids for r in pieces.encode(frame(spark, ODD), PIECES).collect()}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, ODD), PIECES), PIECES).collect()}
    for i, t in enumerate(ODD):
        want = model.encode(t or "", add_bos=True, add_eos=True)
        assert ids[i] == want and got[i].n_tokens == len(want) and back[i] == model.decode(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(want).encode()).hexdigest()
    assert pieces.round_trip(frame(spark, []), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "▁", "the", "ing", "é", "日", "😀", "\t", "<0x0A>", "==", "2024", "\x00", "tion"]), max_size=40))
def test_pieces_on_drawn_texts(parts):
    enc, text = pieces.encoder(PIECES), "".join(parts)
    assert enc.encode([text])[0].tolist() == enc.model.encode(text)


def test_words_match_the_library():
    tok, whole = packing.tokenizer(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    pool = ["a", " ", "\n", "é", "é", "Σ", "İ", "ing'", "'s", "日本", "<|endoftext|>", "\x1c", "\u0085", "​", "Foo.", "foo,", "1", ".."]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(2000)]
    got = tok.ids_of(texts)
    assert [g.tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing_covers_every_id(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(string.ascii_lowercase + "  ", k=rng.randint(1, 4000))) for _ in range(60)]
    rows = packing.pack(frame(spark, texts).repartition(5), WORDS, size=256).collect()
    whole = Tokenizer.from_file(WORDS)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == packing.crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids[i])
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 256
    assert len(by_doc) == len(texts) and len(by_seq) == -(-sum(map(len, ids)) // 256)
    assert packing.pack(frame(spark, []), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 50)))
def test_runs_place_each_length_once(counts):
    runs = packing.shortest_pack_first(counts, 32)
    total = sum(n * c for n, c in counts.items())
    used = {}
    for _, a, b, _, n, first, offset in runs.tolist():
        for s in range(first, first + b - a):
            used.setdefault(s, set()).update(range(offset, offset + n))
    assert sum(map(len, used.values())) == total and len(used) == -(-total // 32)


def brute_near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


def test_full_sets_join_in_the_engine(spark):
    sets = near.full_sets(frame(spark, ["a b c d e f", "g h i j k l", None]), spark.createDataFrame([(0,), (2,)], "doc_id long"), "doc_id", "text")
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "ArrowEvalPython" not in plan and {r.doc_id for r in sets.collect()} == {0, 2}


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(300)]
    base = [rng.choices(vocabulary, k=60) for _ in range(6)]
    texts = list(ODD[:7]) + ["A b c", "a  B\tc", "one"]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).capitalize())
    texts += [texts[-1]] * 3
    sets, label = brute_near(texts)
    got = {r.doc_id: r for r in near.near_duplicates(frame(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i)
    rows = near.near_duplicates(frame(spark, ["a b", "a b", "a b"], [None, 7, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (7, 7, True), (7, 7, True)]
    assert near.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (7, 7)]
    rng.shuffle(edges)
    got = dict(near.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {250: 200, 300: 200}
    assert got == want


def brute_lines(texts, ids):
    keys = lambda t: [k if len(k) >= 10 else None for k in (x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n"))]
    held = {}
    for t, i in zip(texts, ids, strict=True):
        for k in keys(t or ""):
            if i is not None and k is not None:
                held.setdefault(k, set()).add(i)
    out = []
    for t, i in zip(texts, ids, strict=True):
        rows = (t or "").split("\n")
        out.append([x for x, k in zip(rows, keys(t or ""), strict=True) if i is None or k is None or min(held[k]) == i])
    return out


def test_lines_with_odd_rows(spark):
    texts = [*ODD, "A shared line here\nown line number one", " a SHARED line here\t\nown line number two\nshort", "own line number two", "own line number two"]
    ids = [*range(len(ODD) + 2), None, 3]
    got = lines.dedup_lines(frame(spark, texts, ids))
    assert got.columns == ["doc_id", "text", "sig", "n", "n_lines", "n_dropped"]
    twin = [*texts[-4:], None, texts[-3]]  # an id that a text with repeated lines and a null share
    odd = frame(spark, twin, [1, 2, 3, 4, 2, 2]).withColumnRenamed("n", "N_lines")
    again = lines.dedup_lines(odd)
    assert again.columns == ["doc_id", "text", "sig", "n_lines", "n_dropped"]
    assert sorted(r.text or "" for r in again.collect()) == sorted(map("\n".join, brute_lines(twin, [1, 2, 3, 4, 2, 2])))
    assert lines.dedup_lines(odd, counts=False).columns == odd.columns
    want = sorted((str(i), "\n".join(k), len((t or "").split("\n"))) for t, i, k in zip(texts, ids, brute_lines(texts, ids), strict=True))
    assert sorted((str(r.doc_id), r.text or "", r.n_lines) for r in got.collect()) == want
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_index_is_reversible(spark):
    rng = random.Random(4)
    pool = [f"line number {i:04d}" for i in range(80)]
    texts = ["\n".join(rng.choices(pool, k=6)) for _ in range(60)]
    docs = frame(spark, texts)
    empty = lines.new_index(docs, shards=8)
    posted = lines.postings_of(docs, 8)
    first = lines.insert(empty, posted.where("doc_id < 30"))
    both = lines.insert(first, posted)  # documents that are in it already stay once
    back = lines.delete(both, docs.where("doc_id >= 30").select("doc_id"))
    table = lambda index: {(r.h1, r.h2): (r.n_docs, r.first_doc) for r in index.counts.collect()}
    assert table(both) == table(lines.insert(empty, posted)) and table(back) == table(first)
    for index in (both, back):  # no key that is held is missing from its filter
        cells = {(r.shard, r.batch): lines.CuckooFilter.load(bytes(r.cells)) for f in index.filters for r in f.collect()}
        for r in index.counts.collect():
            assert cells[r.shard, r.batch].has(np.array([r.h1]), np.array([r.h2])).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 50_000))
    f = lines.CuckooFilter.for_keys(40_000)
    assert f.add(h1[:40_000], h2[:40_000]) and f.has(h1[:40_000], h2[:40_000]).all()
    assert f.has(h1[40_000:], h2[40_000:]).mean() < 0.01
    f.remove(h1[:10_000], h2[:10_000])
    assert f.has(h1[10_000:40_000], h2[10_000:40_000]).all() and f.has(h1[:10_000], h2[:10_000]).mean() < 0.01


def test_secrets_base_and_added():
    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])

    rng = random.Random(9)
    pool = ["password", "Token", "API_KEY", " ", "=", ":", "'", "AKIA", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef", "abcdef", "é", "\n", "x", "ſecret"]
    for _ in range(3000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        base, every = secret_scan.scan(t)
        assert base == brute(t) and set(base) <= set(every)
    for _ in range(2000):  # added spans overlap no base span
        t = "".join(rng.choices(["client_secret", "token", "=", " ", "'Zx9!kkLm2'", '"p3QzzT81kd9"', "abcdefgh1", "\n", "AKIA" + "A" * 18, "0" * 25], k=12))
        base, every = secret_scan.scan(t)
        assert not any(k == 3 and any(s < b and a < e for s, _, e in base) for a, k, b in every)
    found = lambda t: [t[a:b] for a, k, b in secret_scan.scan(t)[1] if k == 3]
    assert found('k = "Zx9!kkLm2"\nDB_PASSPHRASE = k\n') == ["Zx9!kkLm2"]
    assert found('{"client_secret_value": "p3Q" + "zzT81kd9"}') == ["p3Q", "zzT81kd9"]
    assert found("token_count = 123456789; the secretary: something else; api.key='${ENV}'") == []
    assert secret_scan.redact_text("my password = hunter2222 ok") == "my password = [REDACTED] ok"


def test_secrets_beyond_base_spans():
    def kinds(t):
        return {(k, t[a:b]) for a, k, b in secret_scan.scan(t)[1]}

    text = 'db_password = "Winter2024!#xyz&77"\nnext'
    assert kinds(text) == {(0, 'password = "Winter2024'), (3, "!#xyz&77")}
    assert secret_scan.redact_text(text) == 'db_password = "[REDACTED]"\nnext'
    text = "db_password = hunter2!x9#Q and more"
    assert secret_scan.redact_text(text) == "db_password = [REDACTED] and more"
    text = f"client_secret = '{'0a' * 15}!Zq'"  # two base spans, neither covers the literal
    assert secret_scan.redact_text(text) == "client_secret = '[REDACTED]'"
    text = f"auth_key = '!Zq{'0a' * 15}#Kd'"  # a base span inside it
    assert secret_scan.redact_text(text) == "auth_key = '[REDACTED]'"
    text = "passphrase = '!x#Y9 password=abcdef1 q?Z4wwWw'"  # an assignment inside it
    assert secret_scan.redact_text(text) == "passphrase = '[REDACTED]'" and {k for k, _ in kinds(text)} == {0, 3}
    assert kinds("api_key = 'abcDEF123456'") == {(0, "api_key = 'abcDEF123456")}  # one base span covers it


def test_secrets_of_any_length_and_over_lines():
    rng = random.Random(4)
    key = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=10_000))
    pem = "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *[key[i : i + 64] for i in range(0, 1600, 64)], "-----END RSA PRIVATE KEY-----"])
    deep = lambda t, n: "\n".join(" " * n + line for line in t.split("\n"))
    gap = " " * 40
    for text, want in [
        (f'private_key = "{key}"\nx = 1', 'private_key = "#"\nx = 1'),
        (f"access_key: {key}\nx: 1", "access_key: #\nx: 1"),
        (f"pwd{gap}={gap}'{key[:20]}'", f"pwd{gap}={gap}'#'"),
        (f'private_key = """{pem}"""\nx = 1', 'private_key = """#"""\nx = 1'),
        (f"credentials = '''{pem}'''", "credentials = '''#'''"),
        (f'PRIVATE_KEY="{pem}"\nX=1', 'PRIVATE_KEY="#"\nX=1'),
        (f"a: 1\nprivate_key: |\n{deep(pem, 2)}\n\nnext: hello", "a: 1\nprivate_key: |\n#\n\nnext: hello"),
        (f"- a: x\n  private_key: >-\n{deep(pem, 4)}\n- a: y", "- a: x\n  private_key: >-\n#\n- a: y"),
        (f"data:\n  conf.yaml: |-\n    private_key: |\n{deep(pem, 6)}\n    other: x\nn: h", "data:\n  conf.yaml: |-\n    private_key: |\n#\n    other: x\nn: h"),
        (f"PRIVATE_KEY=$(cat <<'EOF'\n{pem}\nEOF\n)\nX=1", "PRIVATE_KEY=$(cat <<'EOF'\n#\nEOF\n)\nX=1"),
        (f"private_key = <<-EOT\n{deep(pem, 4)}\n  EOT\nx = 1", "private_key = <<-EOT\n#\n  EOT\nx = 1"),
        ('doc = """\npassphrase = "Zx9!kkLm2"\n""" + x\nauth_key = "Qr9!kkLm2"', 'doc = """\npassphrase = "#"\n""" + x\nauth_key = "#"'),
    ]:
        assert secret_scan.redact_text(text, "#") == want


def test_secrets_frames(spark):
    rows = secret_scan.find_secrets(frame(spark, [*ODD, "token=abcdef1", "token=abcdef1"])).collect()
    assert len(rows) == len(ODD) + 2 and [r.n_assign for r in rows[-2:]] == [1, 1] and rows[1].spans == ""
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    kept = secret_scan.redact(frame(spark, [None, "token=abcdef1", "clean"])).collect()
    assert [r.text for r in kept] == [None, "token=[REDACTED]", "clean"] and kept[0].sig == "s"


def test_main_text():
    page = """<html><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">Accept all of these long cookies
    now please, they are good for you and us.</div><div id=wrap><div class=sidebar><p>Side text that is long enough to look like a paragraph.</p></div>
    <div class=content><h1>Title &amp; more</h1><p>First para  with\nnew line and <a href=x>a link</a> that goes on for quite a while.<p>Short.
    <ul><li>one<li>two</ul><script>var p = "</p>";</script><p>Last paragraph, again with some text in it.</p><form><p>Form text</p></form></div>
    <div id=comments><div class=comment>I like it, this is a long reader comment of many words.</div></div></div><footer>foot &copy;</footer>"""
    assert extraction.main_text(page).split("\n") == [
        "Title & more", "First para with new line and a link that goes on for quite a while.", "Short.", "one", "two",
        "Last paragraph, again with some text in it.",
    ]
    assert extraction.main_text("") == "" and extraction.main_text("<p><p></p>") == "" and extraction.main_text("plain text") == "plain text"


def words(n, stem):
    return " ".join(f"{stem}{i % 97}" for i in range(n))


@pytest.mark.parametrize("n", [1, 4, 20, 90])
def test_main_text_is_whole_at_any_length(n):
    lead, body, end = words(30, "lead"), f"<p>{words(60, 'body')}</p>" * n, f"<section><h2>End</h2><p>{words(6, 'end')}</p></section>"
    want = ["Title", lead, *[words(60, "body")] * n, "End", words(6, "end")]
    parts = f"<h1>Title</h1><div class=lead>{lead}</div><div class=text>{body}</div>{end}"
    page = "<body><nav><a href=/>Home</a></nav><div id=header><h1>Site</h1></div>%s<div><ul><li><a href=/a>One more</a></ul></div><footer>foot</footer>"
    for inner in (
        f"<article>{parts}</article>", f"<div id=post>{parts}</div>", f"<article><header><h1>Title</h1></header><div>{lead}</div><div>{body}</div>{end}</article>",
        f"<main><h1>Title</h1><article><p>{lead}</p>{body}{end}</article></main>", f"<main>{parts}</main>",
    ):
        assert extraction.main_text(page % inner).split("\n") == want, inner[:60]
    assert extraction.main_text(f"<body>{parts}").split("\n") == want


@pytest.mark.parametrize("wrapper", [
    "class='content-area has-sidebar'", "id=wrap class='with-sidebar'", "class=no-sidebar", "class='layout sidebar-right'", "class=nav-open",
    "class=sidebar-right", "class='widget widget-wrap'", "id=search",
])
def test_main_text_in_wrappers(wrapper):
    paras = f"<p>{words(60, 'body')}</p>" * 4
    others = "<div class=sidebar><p>Some side text here.</p></div><div class=comments><article class=comment><p>I like it very much.</p></article></div>"
    for inner in (f"<article><h1>Title</h1>{paras}</article>", f"<main><h1>Title</h1>{paras}</main>", f"<h1>Title</h1>{paras}"):
        page = f"<body><nav><a href=/>Home</a></nav><div {wrapper}>{inner}{others}</div><div class=site-footer>All about this site.</div>"
        assert extraction.main_text(page).split("\n") == ["Title", *[words(60, "body")] * 4]
    # a name that says so still leaves out what stands beside an article, however long
    page = f"<body><div class=related-posts><p>{words(300, 'other')}</p></div><article><h1>Title</h1><p>Short.</p><div id=comments>{paras}</div></article>"
    assert extraction.main_text(page) == "Title\nShort."


def test_pages_whole_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r for r in queries.op7_html(spark, sf).collect()}
    from html import unescape

    for p in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b) and rows[p.page_id].n_chars == len(rows[p.page_id].text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], "page_id long, url string, html string")
    assert [r.text for r in extraction.extract(odd).collect()] == ["", "", ""]


def test_warc_pushdown_and_odd_pages(spark):
    long = "<p>" + "ä" * 200
    rows = [(3, "http://a/ x", long), (1, None, long), (None, "u\n", long), (2, "v", None), (5, "w", "<b>short</b>"), (6, "w", "<b>short</b>"), (9, "z", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for page_id, _, html in rows:
        assert got[page_id].payload_digest == digest(html) and got[page_id].payload_bytes == len((html or "").encode())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {3: ("revisit", 1)}
    path = new_folder(spark, "warc-test")
    warc.archive(pages, path)
    read = warc.read(spark, path)
    assert {r.record_id for r in read.where("record_type = 'response' AND record_id IN ('1', '3', '9')").collect()} == {"1", "9"}
    assert read.where("target_uri LIKE 'http://a/%'").first().target_uri == "http://a/%20x"
    assert warc.read(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    plan = read.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "record_type" in plan
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]
    rows += [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, []), (550, [0.0] * 8), (None, [1.0] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k(spark):
    rows, frame_ = vectors(spark)
    ok = {i: np.floor(256 * np.resize(np.array(v + [0.0] * (8 - len(v))), 8)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for r in topk.top_k(frame_, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    found = topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**63 - 1), (2, -(2**63))]


def test_nearest_recall(spark):
    rows, frame_ = vectors(spark)
    ok = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    got = {}
    for r in onebit.nearest(frame_, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r["rank"], r.score)
    hit = 0
    for q in (queries_ := [i for i in ok if i % 20 == 0]):
        best = sorted(((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q))[:20]
        hit += len({i for _, i in best} & set(got[q]))
        assert all(got[q][i][1] == pytest.approx((ok[q] * ok[i]).sum(), rel=1e-12, abs=1e-12) for i in got[q])
    assert set(got) == set(queries_) and hit >= 0.9 * 20 * len(queries_)


def test_nearest_of_repeated_queries(spark):
    rows, _ = vectors(spark)
    rows = [(i, v) for i, v in rows if i is not None and i < 400]
    repeated = [*rows, rows[40], rows[40], rows[80], rows[7]]
    find = lambda r: sorted(map(tuple, onebit.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.col("vec_id") % 40 == 0).collect()))
    got, want = find(repeated), find(rows)
    for q in (40, 80):
        ids = [r[2] for r in got if r[0] == q]
        assert len(ids) == 20 and all(ids.count(i) == 1 for i in ids if i not in (7, 40, 80))
        assert {r[2] for r in want if r[0] == q} >= set(ids) and len(set(ids)) >= 17


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(0)
    bad, clean = ["moron", "scumbag", "idiotic"], [f"word{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=rng.randint(5, 80))
        if i % 4 == 0:
            words += rng.choices(bad, k=rng.randint(2, 6))
        rng.shuffle(words)
        rows.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 200"), marks.where("doc_id < 200"))
    scored = toxicity.score(docs, model).join(marks.withColumnRenamed("toxic", "label"), "doc_id").where("doc_id >= 200").collect()
    assert sum(r.toxic == bool(r.label) for r in scored) >= 0.98 * len(scored)
    assert np.all(np.diff(model.thresholds) >= 0) and all(0 <= r.severity <= 3 for r in scored)
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd)
    clash = docs.withColumnsRenamed({"sig": "Toxic", "n": "grade"})  # columns named like added ones
    assert toxicity.score(clash, model).columns == ["doc_id", "text", "severity", "grade", "toxic"]
    kept = toxicity.clean(clash, model)
    assert kept.columns == clash.columns and {r.Toxic for r in kept.collect()} == {"s"}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("NOT toxic").collect()}
    none = toxicity.train(docs, marks.where("toxic = 0"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_pipeline_stages(spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    toxic = dict(con.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = step(spark, docs, sf)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        docs = corpus_pipeline.stage(docs, "test-stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(after) < set(before) and all(toxic.get(i) != 0 for i in set(before) - set(after))
        elif name == "line dedup":
            ids = sorted(before)
            assert after == dict(zip(ids, map("\n".join, brute_lines([before[i] for i in ids], ids)), strict=True))
        elif name == "near dedup":
            ids = sorted(before)
            assert set(after) == {ids[k] for k, c in enumerate(brute_near([before[i] for i in ids])[1]) if k == c}
        else:
            assert after == {i: secret_scan.redact_text(t) for i, t in before.items()}
            assert not any(secret_scan.base_spans(t) for t in after.values())
        assert all(r.n_chars == len(r.text) for r in docs.collect())

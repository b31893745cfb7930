"""Secrets, leaks, pieces, archives and pages: against brute force, and odd rows."""

import base64
import gc
import hashlib
import random
import re
import weakref

import pytest

from panelcast.llm import decontaminate, html_wrapper, pieces, secret_ledger, warc
from panelcast.session import scratch_path

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                   for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (("assign", re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def base_spans(text):
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, rule, group, least) in enumerate(BASE)
             for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


SECRETS = [
    None, "", "nothing here", "é😀 token = \"0123456789abcdef0123\" and more", "token=token:abcdefghijklmno", "PASSWORD : short",
    "token=secret=abcdefghijklm", "Api_Key='aaaaaaaaaaaa' apikey:bbbbbbbbbbbb", "AKIAAKIA" * 4, "AKIA123", "f" * 40 + "g" + "e" * 15,
    "x" * 30_000 + " secret=" + "y" * 500 + "\n" + "passwd=0123456789abcdef " * 200, "ghp_" + "A1" * 20, "a=b,c:d",
    "-----BEGIN RSA PRIVATE KEY-----",
]


def test_secrets_are_those_of_the_rules(spark):
    rows = [(i, t, 5) for i, t in enumerate(SECRETS + SECRETS[3:5])]
    got = secret_ledger.scanned(spark.createDataFrame(rows, "doc_id long, text string, n_hex int").select("doc_id", "text"))
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        want = base_spans(text)
        spans = [s for s in got[doc]["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in secret_ledger.BASE] == want
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        counts = [sum(s.startswith(k + ":") for s in want) for k in secret_ledger.BASE]
        assert [got[doc][f"n_{k}"] for k in secret_ledger.BASE] == counts
    assert got[12]["spans"] == "github:0:44" and got[14]["spans"] == "pem:0:31"


def test_ledger_scans_only_what_it_lacks(spark):
    first = spark.createDataFrame([(t,) for t in SECRETS[:5]], "text string")
    ledger = secret_ledger.materialized(
        secret_ledger.update_ledger(first), "ledger")
    blobs = {t or "" for t in SECRETS[:5]}
    assert ledger.count() == len(blobs) * len(secret_ledger.RULES)
    assert secret_ledger.update_ledger(first, ledger).count() == 0
    more = spark.createDataFrame([(t,) for t in SECRETS], "text string")
    assert secret_ledger.update_ledger(more, ledger).select("blob").distinct().count() == len(set(SECRETS) - {None}) - len(blobs)
    newer = tuple((k, v + (k == "hex"), *rest) for k, v, *rest in secret_ledger.RULES)
    again = secret_ledger.update_ledger(first, ledger, newer)
    assert {(r["kind"], r["version"]) for r in again.collect()} == {("hex", 2)} and again.count() == len(blobs)
    assert secret_ledger.update_ledger(first, secret_ledger.empty_ledger(spark)).count() == ledger.count()


def test_redaction(spark):
    ledger = secret_ledger.update_ledger(spark.createDataFrame([(t,) for t in SECRETS], "text string"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_ledger.redacted(rows, ledger).collect()}
    assert got[0] is None and got[1] == "" and got[2] == SECRETS[2] and got[3] == "é😀 [secret]\" and more"
    assert got[7] == "[secret]' [secret]" and all(not base_spans(t) for t in got.values())


def test_private_keys_go_whole(spark):
    rnd = random.Random(2)
    lines = ["".join(rnd.choice("ABCXYZabcxyz0189+/") for _ in range(64)) for _ in range(25)] + ["Qx7+aZ=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n"
    body, many = "\n".join(lines), "\n".join(lines[:25] * 2_000)
    texts = {
        f"a\n{begin}\n{body}\n{end}\nb": "a\n[secret]\nb", f"a {begin} {' '.join(lines)} {end} b": "a [secret] b",
        f"a\n{begin}\n{head}{body}\n{end}\nb": "a\n[secret]\nb", f"é😀\n{begin}\r\n{body}\nThe end of it": "é😀\n[secret]\nThe end of it",
        f'k="{begin}\\n' + "\\n".join(lines) + f'\\n{end}\\n"; x': 'k="[secret]\\n"; x', f"{begin}\n{head}{body}": "[secret]",
        f"{begin}\n{body}\n{begin}\n{body}\n{end}": "[secret]\n[secret]", f"{begin}\n{many}\n{end} b": "[secret] b",
        f"{begin}\n{many}\nplain words": "[secret]\nplain words", f"the line {begin} starts a key": "the line [secret] starts a key",
        f"{begin} {'-' * 9} no key": f"[secret] {'-' * 9} no key", f"-----BEGIN PUBLIC KEY-----\nshort\n{end}": None,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_ledger.redacted(rows, secret_ledger.update_ledger(rows)).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert got[i] == (text if want is None else want), text[:200]


def items():
    rnd = random.Random(4)
    return [(i, " ".join(f"t{rnd.randrange(300)}" for _ in range(20)) + ". " + " ".join(f"a{rnd.randrange(300)}" for _ in range(6)) + ".")
            for i in range(30)] + [(90, None), (91, ""), (92, "too short")]


def test_leaks_are_found_and_clean_texts_left(spark):
    rnd, tests = random.Random(9), items()
    filler = [f"t{i}" for i in range(300)] + [f"f{i}" for i in range(300)]
    rows, want = [(0, None), (1, ""), (2, "too short")], set()
    for doc in range(3, 60):
        words = [rnd.choice(filler) for _ in range(rnd.randint(5, 900))]
        for item in rnd.sample(range(30), rnd.randint(0, 2)):
            at = rnd.randint(0, len(words))
            words[at:at] = tests[item][1].upper().split(" ")
        rows.append((doc, " ".join(words)))
    for doc, text in rows:
        have = decontaminate.shingles(decontaminate.words(text))
        for item, t in tests:
            need = decontaminate.shingles(decontaminate.words(t)) if len(decontaminate.words(t)) >= 5 else set()
            if need and len(need & have) >= 0.6 * len(need):
                want.add((doc, item))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(tests + tests[:3], "item_id long, text string")
    for size in (500, 7):
        got = decontaminate.with_leaks(docs, bench, items_per_index=size, into="found").selectExpr("doc_id", "explode(found) as f")
        assert {(r["doc_id"], r["f"]["item_id"]) for r in got.collect()} == want
    assert decontaminate.leaked_pairs(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaked_pairs(docs.limit(0), bench).count() == 0


def test_a_question_alone_is_a_leak(spark):
    """A full question before an answer that is longer, and items of scripts without spaces."""
    rnd = random.Random(3)
    question, answer = (" ".join(f"{c}{rnd.randrange(10 ** 6)}" for _ in range(n)) for c, n in (("q", 10), ("a", 40)))
    chinese = "水的沸点在标准大气压下是多少度？一百摄氏度。"
    bench = spark.createDataFrame([(1, f"{question}? {answer}."), (2, chinese), (3, "ประเทศไทยมีกี่จังหวัด"), (4, "天地")], "item_id long, text string")
    fill = " ".join(f"f{rnd.randrange(10 ** 6)}" for _ in range(200))
    docs = [(10, f"{fill} {question} {fill}"), (11, f"{fill} {question[:30]} {fill}"), (12, f"前文。{chinese}后文"), (13, "水是生命之源。"),
            (14, f"{fill} ประเทศไทยมีกี่จังหวัด"), (15, "天地"), (16, "水的沸点在标准大气压下是多少度"), (17, fill)]
    got = decontaminate.leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 1), (12, 2), (14, 3), (16, 2)]
    assert next(r for r in got if r["doc_id"] == 10)["question_overlap"] == 1.0


@pytest.mark.parametrize("size", [500, 1])
def test_short_items_are_exact_phrases(spark, size):
    """Items of three or four words, also where an index holds no other; shorter ones are no evidence."""
    bench = [(1, "Is water wet? Yes."), (2, "is WATER wet"), (3, "Yes."), (4, "not here at"), (5, "Is water wet? Yes!")]
    docs = [(10, "they ask: is water wet? Yes, they say"), (11, "Is water wet, yes or no"), (12, "is water"), (13, "water wet is yes"),
            (14, None), (15, "wet is water wet")]
    got = decontaminate.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(bench, "item_id long, text string"), size, "found").collect()
    found = {r["doc_id"]: sorted(f["item_id"] for f in r["found"]) for r in got}
    assert found == {10: [1, 2, 5], 11: [1, 2, 5], 12: [], 13: [], 14: [], 15: [2]}


def test_one_index_is_held_at_a_time(spark, monkeypatch):
    made, alive, make = [], [], decontaminate._leaks_of

    def counted(index):
        made.append(weakref.ref(index))
        gc.collect()
        alive.append(sum(r() is not None for r in made))
        return make(index)

    monkeypatch.setattr(decontaminate, "_leaks_of", counted)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame([(1, items()[3][1]), (1, items()[3][1]), (2, None)], "doc_id long, text string")
    got = decontaminate.with_leaks(docs, bench, items_per_index=7, into="found").collect()
    assert sorted((r["doc_id"], [f["item_id"] for f in r["found"]]) for r in got) == [(1, [3]), (1, [3]), (2, [])]
    assert len(alive) > 3 and max(alive) == 1


def test_block_bounds_hold():
    tests = [x for x in items() if x[1] and len(x[1]) > 20]
    df = {}
    for _, t in tests:
        for w in set(decontaminate.words(t)):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.LeakIndex(tests, df, len(tests), 26.0)
    asked = decontaminate.np.arange(0, len(index.terms), 3)
    ones = decontaminate.np.ones(len(asked))
    bounds = index.index.bounds(asked, ones)
    assert all(index.index.scores(b, asked, ones).max() <= bounds[b] + 1e-12 for b in range(index.index.n_blocks))


ODD_TEXTS = [None, "", " ", "  two  spaces ", "a\n\tb\x00", "日本語́ ﬁ Ａ 😀", "▁mark ▁▁", "x" * 5_000, "ab" * 4_000 + "  " * 60,
             "A.B,c;d://e?f=g&h " * 50, "<s></s><unk><0x41>"]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_pieces_are_those_of_the_library(model):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(6)
    texts = ODD_TEXTS + ["".join(rnd.choice("abcdefghij .,▁é\n日") for _ in range(rnd.randint(1, 400))) for _ in range(300)]
    for text in texts:
        ids = model.encode(text).tolist()
        assert ids == library.encode(text or "")
        assert model.decode(ids) == (text or "").replace("▁", " ")


@pytest.mark.parametrize("fault", ["scores", "texts"])
def test_other_models_are_an_error(monkeypatch, fault):
    library = pytest.importorskip("sentencepiece")

    class Other(library.SentencePieceProcessor):
        def get_score(self, i):
            return super().get_score(i) * (0.5 if fault == "scores" else 1)

        def encode(self, text):
            return super().encode(" ".join(text.split()) if fault == "texts" else text)

    monkeypatch.setattr(library, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        pieces.load()


def test_a_small_window_commits_the_same_path(model, monkeypatch):
    text = "".join(random.Random(7).choice("abcdehinorst") for _ in range(3_000))
    whole = model.path(text).tolist()
    monkeypatch.setattr(pieces, "COMMIT_EVERY", 1)
    assert model.path(text).tolist() == whole


def test_encoded_rows(spark, model):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "x", 2)], "doc_id long, text string, ids int")
    got = pieces.encoded(rows, model).collect()
    assert len(got) == len(ODD_TEXTS) + 1 and all(r["decoded_ok"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert pieces.encoded(rows.limit(0), model).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "u\r\nWARC-Type: x", "é\r\n\r\nWARC/1.1\r\n\r\n"),
             (6, "http://a/6", "y" * 200_000), (7, "http://a/7", "<p>x</p>"), (None, "http://n", "<p>x</p>"), (7, "http://a/7", "<p>x</p>")]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int"), path, least)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(pages)
    assembled = warc.assemble(records)
    assert assembled.where("request is null or metadata is null").count() == 0
    got = sorted(map(tuple, warc.captures(assembled).collect()), key=str)
    want = []
    for page, _, html in pages:
        size = len((html or "").encode())
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        top = max(same) if size >= least and same else page
        kind = "response" if page == top else "revisit"
        want.append((page, size, digest(html), kind, None if page == top else top, True if page == top else None))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.assemble(warc.read_records(spark, path))).count() == 0


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Home {title}</a></li></ul></nav>"
            f"<div class='ad'>Buy {title}</div><div id=top>Always here</div><article><h1>{title}</h1>{body}{extra}</article>"
            f"<div class=comments><p>so {title}</p></div><form>name</form><footer>&copy; {title}</footer></body></html>")


def test_main_text(spark):
    rows = [(i, f"http://h.tld/{i}", page(f"T{i} &amp; co", [f"p{i}  a\n b", f"<b>q{i}</b>r"][: 1 + i % 2])) for i in range(12)]
    rows += [(50, None, None), (51, "", ""), (52, "http://h.tld/", "no markup &lt;x&gt;"), (53, "x://y/", "<article><p>cut <b>off&am"),
             (54, "http://z/", "<div><div>" * 3_000 + "deep"), (0, "http://h.tld/0", rows[0][2])]
    got = [tuple(r) for r in html_wrapper.main_text(spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, text int")).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    for i in range(12):
        blocks = [f"T{i} & co", f"p{i} a b", f"q{i}r"][: 2 + i % 2]
        assert by[i][2] == "\n\n".join(blocks) and by[i][3] == len(by[i][2])
    assert by[50] == (50, None, "", 0) and by[51][2] == "" and by[52][2] == "no markup <x>" and by[53][2] == "cut off&am" and by[54][2] == "deep"
    assert html_wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constants_of_a_host_are_template(spark):
    """Without an article element, what all pages of a host share goes; on a lone page it can't be told."""
    def bare(i):
        return f"<body><div><p>Welcome to the site</p></div><div><p>story {i} begins</p><p>and ends {i}</p></div><div>Imprint</div></body>"

    rows = [(i, f"http://h.tld/{i}", bare(i)) for i in range(10)] + [(99, "http://lone.tld/", bare(99))]
    got = {r[0]: r[2] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 begins\n\nand ends 3"
    assert got[99] == "Welcome to the site\n\nstory 99 begins\n\nand ends 99\n\nImprint"


@pytest.mark.parametrize("start, end", [
    ('<body class="single has-sidebar"><article>', "</article></body>"), ('<article class="post comments-open">', "</article>"),
    ('<body><div id="page" class="no-sidebar">', "</div></body>"), ('<div class="share-enabled">', "</div>"),
    ('<body class="sidebar"><main class="search">', "</main></body>"), ("<body><form action=x>", "</form></body>"),
    ('<p>Site</p><div class="widget">', "</div>")])
def test_names_never_cost_the_whole_page(spark, start, end):
    rows = [(i, f"http://h.tld/{i}", f"{start}<h1>title {i}</h1><p>story {i}</p><div class='site-footer'>foot {i}</div>"
             f"<div class='ad'>buy {i}</div><ul class=main-nav><li>at {i}</ul>{end}") for i in range(9)]
    got = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"title {r['page_id']}\n\nstory {r['page_id']}" for r in got)


@pytest.mark.parametrize("inside, want", [
    ('<p title="a hidden gem">para</p>', "para"), ('<p data-id="sidebar">para</p>', "para"), ("<p data-hidden=1>para</p>", "para"),
    ('<p>a <span hidden>secret</span> b<span class="ad">BUY <i>now</i></span></p>', "a b"),
    ('<p>a <span style="display: none">x <span>y</span> z</span>b <img class="ad"> c</p>', "a b c"),
    ('<p>a <span class="ad">left open</p><p>b</p>', "a\n\nb"), ('<p hidden>gone</p><p HIDDEN="">gone</p><p>b</p>', "b"),
    ("<div>" * 130 + "<nav>menu</nav>deep" + "</div>" * 130 + "<p>tail</p>", "deep\n\ntail"),
    ("<div>" * 400 + "</div>" * 400 + "<ul><li>one<li>two</ul><p>tail", "one\n\ntwo\n\ntail")])
def test_attributes_depth_and_inline_parts(spark, inside, want):
    rows = [(1, "http://lone.tld/", f"<div id=page><article><h1>t</h1>{inside}</article></div><div>side</div>")]
    got = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got["text"] == "t\n\n" + want


def test_tree_matching_aligns_what_it_can():
    one = html_wrapper.read_shape("#root(div(#text),p(#text),ul(li(#link)))", [(1, 5, 5), (1, 6, 6), (1, 7, 7)])
    other = html_wrapper.read_shape("#root(h1(#text),div(#text),ul(li(#link)))", [(1, 1, 1), (1, 5, 5), (1, 8, 8)])
    assert html_wrapper.match(one, other, {}) == 6
    html_wrapper.merge(one, other)
    shape, stats = html_wrapper.write_wrapper(one)
    assert sorted(stats) == sorted([(1, 1, 1), (2, 5, 5), (1, 6, 6), (2, 7, 8)])
    assert sorted(re.findall(r"\w+\(#", shape)) == ["div(#", "h1(#", "li(#", "p(#"]

"""Operators that look at one row at a time, and their lookups over the corpus."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS, rows_of
from tidemark.llm import bpe, decontaminate, html_text, line_dedup, pii, quality, registry

PATH = registry.tokenizer_path()


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m.group())),
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()ab\n😀", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_digest(spark, small):
    found = registry.op3_pii(spark, small).collect()
    texts = dict(rows_of(spark, small))
    assert len(found) == len(texts)
    for r in found:
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= {*r.spans.split(","), ""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in BASE)


def test_pii_adds_confirmed_spans():
    _, spans = pii.find_spans("IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; visa 4222222222222 and 4222222222222x")
    assert [(k, s) for k, s, _, _ in spans] == [("card", 72), ("iban", 5)]
    near, far = pii.find_spans("call +1 (642) 555-6716")[1][0][3], pii.find_spans("x +1 (642) 555-6716")[1][0][3]
    assert near > far


@pytest.mark.parametrize(("text", "found"), [
    ("IBAN DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19 EUR 500", ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"]),
    ("KONTO NR12 DE89370400440532013000 BIC", ["DE89370400440532013000"]),
    ("NO93 8601 1117 947 2024", ["NO93 8601 1117 947"]),
    ("DE88370400440532013000 BIC COBADEFFXXX", []), ("xDE89370400440532013000 BIC", []),
])
def test_pii_ibans_before_upper_case_words(text, found):
    assert [text[s:e] for k, s, e in pii.added_spans(text) if k == "iban"] == found


@pytest.mark.parametrize("text", ["a" * 500_000 + "@", "a@" + "b-" * 500_000, "a@b." * 250_000, "x@" * 500_000, "1." * 500_000,
                                  "+1" + "(" * 500_000, "1 " * 500_000, "+1-" * 300_000, "AB12 " * 200_000, "a" * 500_000 + "@b.cd"])
def test_pii_long_texts(text):
    begin = time.monotonic()
    base, _ = pii.find_spans(text)
    assert time.monotonic() - begin < 20
    emails = [m.span() for m in re.finditer(BASE["email"], text)] if text.startswith("a@b.a") else [(0, len(text))] * text.endswith("@b.cd")
    assert [s[1:] for s in base if s[0] == "email"] == emails


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+-_ é", max_size=40))
def test_emails_equal_the_pattern(text):
    assert [s for s in pii.base_spans(text) if s[0] == "email"] == [s for s in plain_spans(text) if s[0] == "email"]


def test_pii_odd_rows(odd, none):
    assert pii.digest(pii.personal_data(odd)).count() == len(ODD_ROWS) and pii.digest(pii.personal_data(none)).count() == 0


# --- html

@pytest.mark.parametrize(("page", "text"), [
    ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One, two &amp; three.<br><p>Four<b> five</article><footer>f</footer>", "T\nOne, two & three.\nFour five"),
    ("<div id=main><div class='content'><p>Long text, with commas, and more of it to read, surely.</p><ul><li>item one</li></ul></div>"
     "<div class=sidebar><p>Side, bar, text, that, has, commas</p></div><div class='comments'><p>I, too, comment, here</p></div></div>",
     "Long text, with commas, and more of it to read, surely.\nitem one"),
    ("<body><div class='cookie-notice'>We use cookies</div><p>Body &#x41;&nbsp;text</p><script>var a='</p>';</script></body>", "Body A text"),
    ("<p>a<!-- <p>no</p> -->b</p><form><p>Your name</p></form><style>p{}</style>", "ab"),
    ("", ""), ("<html></html>", ""), ("<p>x &lt;b&gt; y", "x <b> y"),
])
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


PARA = "A long paragraph, with some commas, and so many words that it surely gets three points for its length, and more, and more."
TEN, THREE = f"<p>{PARA}</p>" * 10, f"<p>{PARA}</p>" * 3


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<article><h1>T</h1><div class=entry-content>{TEN}</div><ul><li>a fact</li><li>b</li></ul></article>", ["T", *[PARA] * 10, "a fact", "b"]),
    (f"<article><section>{TEN * 3}</section><section>{THREE}</section><h3>S</h3><p>short</p><table><tr><td>c</table></article>",
     [*[PARA] * 33, "S", "short", "c"]),
    (f"<main><article>{TEN}</article><div><p>note</p></div></main>", [*[PARA] * 10, "note"]),
    (f"<div><div class=entry-content>{TEN}</div><h3>Facts</h3><ul><li>a fact</li></ul><section>{THREE}</section><pre>x = 1</pre></div>",
     [*[PARA] * 10, "Facts", "a fact", *[PARA] * 3, "x = 1"]),
    (f"<body><article>{TEN}</article><article><p>second</p></article></body>", [*[PARA] * 10, "second"]),
    (f"<article>{TEN}<ol><li><a href=s>source</a></li></ol><ul class=main-menu><li><a href=h>Home</a></ul></article>", [*[PARA] * 10, "source"]),
    (f"<body><div class=ad>Buy</div><nav><ul><li><a href=h>Home</a></ul></nav><article>{THREE}</article><footer>f</footer></body>", [PARA] * 3),
])
def test_html_keeps_text_beside_the_best_container(page, blocks):
    assert html_text.main_text(page).split("\n") == blocks


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<body><div class='content with-sidebar'>{TEN}</div></body>", [PARA] * 10),
    (f"<body><div class='page no-sidebar'><p>By A</p>{THREE}</div></body>", ["By A", *[PARA] * 3]),
    (f"<body><div class='layout-sidebar'><article>{THREE}</article></div><div class=sidebar><p>side</p></div></body>", [PARA] * 3),
    (f"<body><div id=page><p>By A</p><section class='sidebar-left'>{TEN}<div class=ad><p>Buy</p></div></section></div></body>", ["By A", *[PARA] * 10]),
    (f"<body><div class=footer-fixed><main>{THREE}</main></div></body>", [PARA] * 3),
    (f"<body><article>{THREE}</article><div id=comments>{TEN}<article class=comment-body>{TEN}</article></div></body>", [PARA] * 3),
    (f"<body><div class=content>{THREE}</div><div class=comments>{TEN}</div></body>", [PARA] * 3),
    ("<body><div class=cookie-notice><p>We use cookies, and more, to sell</p></div><p>Short</p></body>", ["Short"]),
    ("<body><div class='page sidebar-left'><p>Short</p></div></body>", ["Short"]),
    (f"<body><article>{THREE}</article><div class=sidebar><p>{PARA}</p></div></body>", [PARA] * 3),
])
def test_html_wrappers_with_unlikely_names(page, blocks):
    assert html_text.main_text(page).split("\n") == blocks


LINKS = "<ul><li><a href=a>One thing</a></li><li><a href=b>Another thing</a></li></ul>"


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<body><form id=aspnetForm><input name=q><label>Search</label><div class=content><h1>T</h1>{THREE}</div></form></body>", ["T", *[PARA] * 3]),
    (f"<body><form id=f><select><option>a</select><article>{THREE}</article></form></body>", [PARA] * 3),
    (f"<body><article>{TEN}<form><p>Write to us, now</p><textarea>x</textarea></form></article></body>", [PARA] * 10),
    ("<body><form><p>Name</p><input></form></body>", [""]),
    (f"<body><div role=form>{TEN}</div></body>", [PARA] * 10),
    *((f"<body><article>{TEN}<section {name}><h2>Part</h2><p>{PARA}</p></section></article></body>", [*[PARA] * 10, "Part", PARA]) for name in (
        "class=legal", "id=related-work", "id=social-history", "class=side-by-side", "class=ad-hoc-note", "class=widget-theory", "id=header-files")),
    (f"<body><main><div class='elementor-widget elementor-widget-heading'><h2>Head</h2></div><div class='elementor-widget elementor-widget-text'>{THREE}</div></main></body>",
     ["Head", *[PARA] * 3]),
    *((f"<body><article>{TEN}<div class={name}><h3>See also</h3>{LINKS}</div></article></body>", [PARA] * 10) for name in ("related", "social", "side", "legal")),
    *((f"<body><article>{TEN}<div class={name}><p>Buy, read or write this</p></div></article></body>", [PARA] * 10) for name in (
        "ad", "newsletter", "cookie-notice", "comments", "comment-list", "share", "sponsored", "entry-footer", "'x sidebar'")),
    (f"<body><div id=wrap><div class=top>Site Name | Home | Contact</div>{THREE}<div class=bottom>Copyright 2024 Acme. All rights reserved</div></div></body>", [PARA] * 3),
    (f"<body><div>Site | Home | Help</div>{THREE}<div>© 2024 Acme</div></body>", [PARA] * 3),
    (f"<body><div id=wrap><div>A, b | c</div>{THREE}<div>The end.</div></div></body>", ["A, b | c", *[PARA] * 3, "The end."]),
    (f"<body><div id=wrap>{THREE}<div>a | b | c</div><p>{PARA}</p></div></body>", [*[PARA] * 3, "a | b | c", PARA]),
    (f"<body><div id=wrap><div><p>Copyright law, © and more</p></div>{THREE}</div></body>", ["Copyright law, © and more", *[PARA] * 3]),
])
def test_html_forms_parts_and_bars(page, blocks):
    assert html_text.main_text(page).split("\n") == blocks


def test_html_pages(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in registry.op10_html_extraction(spark, small).collect():
        inner = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html_text.entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    ("<body><header>Site name and slogan</header><p>One long paragraph, with commas, and words.</p></body>", "One long paragraph, with commas, and words."),
    (f"<div class=page><header class=x><p>Site banner, text</p></header><div class=content><p>{PARA}</p></div></div>", PARA),
    (f"<article><header><h1>T</h1></header><p>{PARA}</p></article>", f"T\n{PARA}"),
    (f"<body><header><main><p>{PARA}</p></main></header></body>", PARA),
    ("<article><p>A, b, c</p><ul><li><a>link one</a></li><li><a>link two</a></li></ul><p>d e f</p></article>", "A, b, c\nlink one\nlink two\nd e f"),
    ("<article><p>A <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> c <label>l</label></p><table><tr><td><a href=x>d</a></table></article>",
     "A x=2 c l\nd"),
    (f"<div><div id=mainNav><a href=a>Home</a></div><div id=mainContent><p>{PARA}</p></div></div>", PARA),
    (f"<body><div class=adsbygoogle><p>Buy, now, and here</p></div><div><p>{PARA}</p></div></body>", PARA),
])
def test_html_headers_formulas_and_links(page, text):
    assert html_text.main_text(page) == text


def made_page(draw):
    """A page from parts, and the blocks that its text has by construction."""
    word = lambda: "".join(draw.choice(list("abcdefgh"), draw.integers(1, 9)))
    prose = lambda n: " ".join(word() + "," * bool(draw.integers(0, 9) == 0) for _ in range(n))
    escaped = lambda t: t.replace("e", "&#101;").replace(" ", "\n  ", 1)
    blocks, inner = [], []

    def block(text, html):
        blocks.append(text)
        inner.append(html)

    title = prose(5)
    head = f"<h1>{title}</h1>"
    block(title, draw.choice([f"<header>{head}</header>", head]))
    for _ in range(draw.integers(3, 9)):
        kind = draw.integers(0, 8)
        text = prose(draw.integers(30, 90))
        if kind < 4:
            a, b = text.split(" ", 1)
            block(text, draw.choice([f"<p>{escaped(text)}</p>", f"<p>{text}", f"<p><a href=x>{a}</a> <i>{b}</i></p>"]))
        elif kind == 4:
            items = [prose(draw.integers(1, 6)) for _ in range(3)]
            blocks.extend(items)
            inner.append("<ul>" + "".join(draw.choice([f"<li>{x}</li>", f"<li><a href=y>{x}</a>"]) for x in items) + "</ul>")
        elif kind == 5:
            cells = [prose(2) for _ in range(4)]
            blocks.extend(cells)
            inner.append("<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table>")
        elif kind == 6:
            block(text, f"<blockquote>{text}</blockquote>")
        else:
            block(h := prose(4), f"<h2>{h}</h2>")
        inner.append(draw.choice(["", "", f"<aside>{prose(20)}</aside>", f"<div class='ad'>{prose(9)}</div>", "<script>if (a<b) x();</script>",
                                  "<!-- <p>no</p> -->", f"<form><p>{prose(9)}</p></form>"]))
    comments = f"<section class='comments'><h3>{prose(3)}</h3>" + "".join(f"<p>{prose(25)}</p>" for _ in range(draw.integers(0, 4))) + "</section>"
    within = "".join(inner) + draw.choice([comments, ""])
    text = draw.choice([f"<article>{within}</article>", f"<main><article>{within}</article></main>", f"<main>{within}</main>",
                        f"<article class='post'><div class='entry-content'>{within}</div></article>"])
    around = [f"<header><p>{prose(30)}</p><nav><a href=z>{prose(1)}</a></nav></header>", f"<nav><ul><li><a href=z>{prose(2)}</a></ul></nav>",
              f"<div class='cookie-notice'><p>{prose(12)}</p></div>", f"<div class=header><p>{prose(8)}</p></div>", f"<div class=ad><p>{prose(20)}</p></div>"]
    after = [comments, f"<aside><p>{prose(40)}</p></aside>", f"<div class='sidebar'><ul><li><a href=q>{prose(3)}</a></ul><p>{prose(20)}</p></div>",
             f"<footer><p>{prose(15)}</p></footer>", f"<div role=contentinfo>{prose(9)}</div>"]
    some = lambda x: "".join(p for p in x if draw.integers(0, 2))
    return f"<html><head><title>{title}</title><style>p {{}}</style></head><body>{some(around)}{text}{some(after)}</body></html>", blocks


def test_html_of_made_pages(spark):
    draw = np.random.default_rng(11)
    made = [made_page(draw) for _ in range(400)]
    pages = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string")
    for r in html_text.extract_text(pages).collect():
        assert r.text.split("\n") == made[r.page_id][1], made[r.page_id][0]
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<i><p>" + "<b>" * 100_000 + "</i>" * 100_000, "<ul>x" * 100_000,
                                  "<p>x,y" * 100_000, "<article>x" * 50_000, "<header>x" * 50_000 + "<article>y", "<ul><li>x" * 50_000,
                                  "<table><tr><td>x" * 30_000, "<a '><b \">" * 50_000, "<div class='side'>x, y" * 50_000, "<script>" * 100_000, "<!-" * 100_000])
def test_html_long_pages(page):
    begin = time.monotonic()
    assert isinstance(html_text.main_text(page), str) and time.monotonic() - begin < 30


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract_text(rows).collect()) == ["", "", "a"]
    assert html_text.extract_text(rows.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"' abpdiv&;!-\n", max_size=80))
def test_html_never_fails(page):
    assert isinstance(html_text.main_text(page), str)


# --- bpe

@pytest.fixture(scope="module")
def encoder():
    vocabulary = bpe.Vocabulary.load(PATH)
    words = sorted(w.encode() for w in (" the", " and", "ing", " Barn", "the", "é", " 12"))
    ids, starts, lens = bpe.Merger(vocabulary).merge_all(words)
    buffer = bpe.Transducer.compile(words, [ids[a : a + n].tolist() for a, n in zip(starts, lens, strict=True)])
    lexicon = bpe.Transducer.open(buffer)
    assert lexicon.lookup([*words, b" th", b"", b"zz"]).tolist() == [*range(len(words)), -1, -1, -1]
    return bpe.Encoder(vocabulary, lexicon), np.array(vocabulary.bytes_of, object)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t\xa0ab'1s.é<|endoftext|>", max_size=40),
                          st.just("<|endoftext|> a<|endoftext|>"), st.just("=" * 300 + "  x")), max_size=6))
def test_bpe_equals_the_library(encoder, texts):
    coder, table = encoder
    ids, lens = coder.encode(pa.array(texts, pa.string()))
    expected = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    ends = np.cumsum(lens)
    for text, e, n, want in zip(texts, ends, lens, expected, strict=True):
        assert ids[e - n : e].tolist() == want.ids
        assert bpe.decode(ids[e - n : e], table).decode() == text


def test_bpe_query(spark, small, odd, none):
    texts = dict(rows_of(spark, small))
    library = Tokenizer.from_file(PATH)
    found = registry.op7_bpe(spark, small).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        encoded = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        ids = np.array(encoded, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(encoded, skip_special_tokens=False).encode()).hexdigest()
    again = bpe.bpe_decode(bpe.bpe_encode(odd, PATH, with_decoded=True), PATH)
    assert again.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    coded = bpe.bpe_decode(bpe.bpe_encode(odd, PATH), PATH)
    assert sorted(r.decoded for r in coded.collect()) == sorted(t or "" for _, t, _ in ODD_ROWS)
    assert bpe.bpe_encode(none, PATH).count() == 0


def test_bpe_lexicon_counts_all_parts(spark):
    texts = [("a thin word",), ("the thin wall",), ("so thin",), ("z" * 300 + " z" + "z" * 299,)] + [("q " + "z" * 300,)] * 3
    words = bpe.frequent_words(spark.createDataFrame(texts, "text string").repartition(len(texts)))
    assert b" thin" in words and b" wall" not in words
    assert max(map(len, words)) <= bpe.LEXICON_WORD_BYTES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(alphabet=" \n\t\xa0ab1s'.é²中<|", max_size=12)), max_size=8))
def test_bpe_pieces_of_many_chunks_equal_the_pattern(texts):
    chunks = [chunk for text in texts for chunk in bpe.CHUNK.findall(text)] + texts
    pieces, many = bpe.pieces_of(pa.array(chunks, pa.string()), ["<|"])
    want = [[c] if c == "<|" else bpe.PIECE.findall(c) for c in chunks]
    assert many.tolist() == [len(w) for w in want]
    assert [p.decode() for p in pieces.to_pylist()] == [p for w in want for p in w]


def test_bpe_words_need_no_pattern_each(encoder, monkeypatch):
    """A call of Python code for each new word is what op7 spent most of its time on."""
    calls = []

    class Counted:
        def findall(self, text, pattern=bpe.PIECE):
            calls.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(bpe, "PIECE", Counted())
    coder, _ = encoder
    text = " ".join(f"w{k}, ({k * 7}) é{k}.\n{k}x" for k in range(3000)) + " don't"
    ids, lens = coder.encode(pa.array([text, text], pa.string()))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert (lens.tolist(), ids.tolist()) == ([len(want)] * 2, want * 2)
    assert calls == [" don't"]


# --- decontamination

def edit_ends(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[1:]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=70), st.text(alphabet="ab ", max_size=40))
def test_myers_equals_dynamic_programming(p, t):
    assert list(decontaminate.distances(p, t)) == edit_ends(p, t)


def test_short_items_are_leaks(spark):
    docs = spark.createDataFrame([(1, "Q: 2 + 2 = 4?"), (2, "so 12 2 4 or 2 2 41"), (3, "What is an ion? An ION."), (4, "anion")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "2+2=4"), (2, "ion"), (3, "What is an ion?"), (4, "?!")], "item_id long, text string")
    hits = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end, r.distance, r.short) for r in hits) == [
        (1, 1, 2, 7, 0, True), (3, 2, 11, 14, 0, True), (3, 2, 18, 21, 0, True), (3, 3, 0, 14, 0, True)]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).orderBy("doc_id").collect()] == [2, 4]
    long = spark.createDataFrame([(9, "what is an ion and what is it not")], "item_id long, text string")
    assert [r.short for r in decontaminate.find_leaks(long.withColumnsRenamed({"item_id": "doc_id"}), long).collect()] == [False]


def all_distances(pattern, text):
    """After each character of text, the least edit distance of pattern to what ends there: plain dynamic programming."""
    codes, place = np.array([ord(c) for c in text], np.int32), np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    for i, c in enumerate(pattern):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (codes != ord(c))]))
        row = np.minimum.accumulate(new - place) + place
    return row[1:]


def test_leaks_query_equals_full_scan(spark, small):
    """Every item against every text, without pieces: the same pairs, and spans at the distance that is given."""
    items = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    texts = {d: decontaminate.plain(t or "") for d, t in rows_of(spark, small)}
    gap = "\0" * (max(map(len, items.values())) + 1)
    ids, joined = list(texts), gap.join(texts.values())
    starts = np.cumsum([0] + [len(texts[d]) + len(gap) for d in ids])
    expected = set()
    for item, pattern in items.items():
        budget = len(pattern) // decontaminate.CHARS_PER_EDIT
        ends = np.flatnonzero(all_distances(pattern, joined) <= budget)
        expected |= {(ids[k], item) for k in np.searchsorted(starts, ends, side="right") - 1}
    found = registry.op4_decontamination(spark, small).collect()
    assert expected and {(r.doc_id, r.item_id) for r in found} == expected
    done = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.item_id, r.start)):
        pattern = items[r.item_id]
        assert edit_distance(pattern, texts[r.doc_id][r.start : r.end]) == r.distance <= len(pattern) // decontaminate.CHARS_PER_EDIT
        assert r.start >= done.get((r.doc_id, r.item_id), 0)
        done[r.doc_id, r.item_id] = r.end


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, x in enumerate(b):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=24, max_size=50), st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60),
       st.lists(st.tuples(st.integers(0, 49), st.sampled_from("abc")), max_size=3))
def test_leaks_of_random_items(item, before, after, edits):
    planted = list(item)
    for at, c in edits:
        planted[at % len(planted)] = c
    text = before + "".join(planted) + after
    found = decontaminate.Matcher([(1, item)]).find(text)
    budget = len(item) // decontaminate.CHARS_PER_EDIT
    assert bool(found) == (min(edit_ends(item, text), default=99) <= budget)
    assert all(edit_distance(item, text[s:e]) == d <= budget for _, s, e, d, _ in found)


@pytest.mark.parametrize("kind", ["int", "long", "string", "decimal(9,0)"])
def test_leaks_keep_the_types_of_ids(spark, kind):
    docs = spark.createDataFrame([("7", "so what is an ion and what is it not, then")], "doc_id string, text string")
    items = spark.createDataFrame([("9", "What is an ion and what is it not?")], "item_id string, text string")
    docs, items = docs.withColumn("doc_id", F.col("doc_id").cast(kind)), items.withColumn("item_id", F.col("item_id").cast(kind))
    hits = decontaminate.find_leaks(docs, items)
    assert hits.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert [(str(r.doc_id), str(r.item_id), r.start) for r in hits.collect()] == [("7", "9", 3)]


def test_every_occurrence_is_a_leak():
    found = decontaminate.Matcher([(1, "a " * 30)]).find("a " * 3000)
    assert len(found) == 100
    assert all(b[1] >= a[2] for a, b in zip(found, found[1:], strict=False)) and all(d == 0 for *_, d, _ in found)


def test_leaks(spark, small, odd, none):
    benchmark = spark.createDataFrame([(1, ODD_ROWS[0][1].replace("fox", "fix")), (2, None), (2, "short")], "item_id long, text string")
    hits = decontaminate.find_leaks(odd, benchmark).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in hits) == [("1", 1, 1), ("6", 1, 1), ("6", 1, 1), ("None", 1, 1)]
    assert decontaminate.without_leaks(odd, benchmark).count() == len(ODD_ROWS) - 4
    assert decontaminate.find_leaks(none, benchmark).count() == 0 and decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0


# --- quality

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.op2_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_quality_equals_plain_numpy(spark, small):
    """The same statistics, features, solve and calibration over all rows at once."""
    rows = rows_of(spark, small)
    labels = {}
    for r in spark.read.parquet(f"{small}/labels.parquet").collect():
        if r.quality is not None:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    x = np.array([quality.statistics(t or "") for _, t in rows], np.float32).astype(float)
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows])
    own = np.array([d in labels for d, _ in rows]) & ~held
    y = np.array([labels.get(d, 0) for d, _ in rows], float)
    half = np.array([xxhash.xxh64_intdigest(b"half", xxhash.xxh64_intdigest(str(d).encode(), 42)) % 2 for d, _ in rows])
    mean, scale = x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-3)
    draw, d = np.random.default_rng(quality.SEED), x.shape[1]
    w, b = draw.normal(size=(d, quality.FEATURES)) / d**0.5, draw.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * (2 / quality.FEATURES) ** 0.5
    z = np.column_stack([z, np.ones(len(z))])

    def ridge(part, n):
        penalty = np.full(z.shape[1], quality.RIDGE * n)
        penalty[-1] = 1e-9 * n
        return np.linalg.solve(z[part].T @ z[part] + np.diag(penalty + 1e-9), z[part].T @ y[part])

    n = int(own.sum())
    raw = np.where(half == 0, z @ ridge(own & (half == 1), n // 2), z @ ridge(own & (half == 0), n // 2))
    bins = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(bins[own])
    weight = np.array([(bins[own] == k).sum() for k in used], float)
    share = np.array([y[own][bins[own] == k].mean() for k in used])
    # The isotonic fit by its min-max formula: the largest over starts of the least over ends of the means.
    fitted = [max(min(np.average(share[a : e + 1], weights=weight[a : e + 1]) for e in range(i, len(used))) for a in range(i + 1))
              for i in range(len(used))]
    expected = np.clip(np.interp(z @ ridge(own, n), (used + 0.5) / quality.BINS * 2 - 0.5, fitted), 0, 1)
    found = {r.doc_id: r for r in registry.op2_quality(spark, small).collect()}
    assert len(found) == len(rows)
    for (doc, _), score, out in zip(rows, expected, held, strict=True):
        r = found[doc]
        assert abs(r.score - score) < 1e-6 and r.held_out == out and r.predicted == (r.score >= 0.7)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(none, labels).count() == 0
    whole, _ = quality.fit_quality(odd, labels)
    assert np.allclose(quality.fit_labelled(odd, labels).ridge, whole.ridge)
    model, _ = quality.fit_quality(odd, labels.limit(0))
    assert quality.good_only(odd, model).columns == odd.columns and quality.good_only(odd, model).count() == len(ODD_ROWS)


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 9)), max_size=20))
def test_isotonic_is_monotone_and_keeps_the_mean(pairs):
    values, weights = np.array([v for v, _ in pairs]), np.array([w for _, w in pairs])
    fitted = quality.isotonic(values, weights)
    assert (np.diff(fitted) >= -1e-12).all() and np.isclose((fitted * weights).sum(), (values * weights).sum())


# --- lines of sites

def test_line_dedup_cases(spark):
    page = "<p>Menu</p><p>own {}</p><p>Menu</p>"
    rows = [(i, "http://A.io/x", page.format(i)) for i in range(4)] + [(9, "http://b.io", page.format(9)), (None, None, None), (3, "http://a.io:80/y", page.format(3))]
    found = line_dedup.site_line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {(r.page_id, r.host): (r.n_lines, r.n_dropped, r.text) for r in found}
    assert len(found) == len(rows)
    assert by[0, "a.io"] == (3, 2, "own 0") and by[9, "b.io"] == (3, 0, "Menu\nown 9\nMenu") and by[None, ""] == (0, 0, "")
    assert line_dedup.site_line_dedup(spark.createDataFrame(rows[:1], "page_id long, url string, html string").limit(0)).count() == 0
    assert line_dedup.host_of(F.lit("x")) is not None


def test_line_dedup_counts_pages_once(spark):
    """Rows that repeat a page are one page, here and in SQL."""
    import duckdb

    rows = [(1, "http://a.io", "<p>Menu</p><p>x1</p>")] * 3 + [(2, "http://a.io", "<p>x2</p>"), (2, "http://a.io", "<p>Menu</p>")]
    rows += [(i, "http://c.io", f"<p>Menu</p><p>y{i}</p>") for i in range(10, 14)] + [(None, "http://c.io", "<p>Menu</p><p>z</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(map(repr, (tuple(r) for r in line_dedup.site_line_dedup(docs).collect())))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert found == sorted(map(repr, con.execute(registry.OP8_SQL).fetchall()))
    assert sum("Menu" in x for x in found) == 4 and sum("x1" in x for x in found) == 3

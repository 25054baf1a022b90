from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import op1_html as op1
from spindrift.llm import op8_bpe as op8
from spindrift.llm import op9_chat as op9
from spindrift.llm import op10_pii as op10
from spindrift.llm.html_kernels import blocks, shared_lines

# --- HTML ---------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.sampled_from([1 << 26, 16]))
def test_shared_lines_are_a_longest_common_subsequence(a, b, bits):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    mask = shared_lines(a, b, bits)
    assert sum(mask) == table[-1][-1]
    rest = iter(b)
    assert all(any(x == y for y in rest) for x, m in zip(a, mask) if m)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-comments">
<nav><a>Home</a></nav><!-- <p>no</p> --><header><p>Site</p></header><div class="ad-box ad">Buy</div><aside>Side</aside>
<article><header><h1>The&nbsp;&amp; title</h1><p>by line</p></header><p><b>One   <i>two</i><br>three<p>Four &lt;5&gt; &copy caf&eacute; &#65;&#x42;</p>
<div id=share>tweet</div><form><p>sign</p></form><div hidden>h</div><div style="display: none">n</div><ul><li>a<li>b</ul>
<section class="comments"><article><p>nice</p></article></section></article>
<div role="alert">cookies</div><footer>foot</footer>"""


def page_rows():
    return [(1, "http://h.example/a/1", PAGE), (2, "http://h.example/a/2", None), (3, None, "<p>no url"), (4, "not a url", ""), (4, "not a url", ""), (None, "http://h.example/a/3", "plain text only")]


def test_main_text_of_a_messy_page(spark):
    table = spark.createDataFrame([(*r, "x", 1) for r in page_rows()], "page_id long, url string, html string, text string, row int")
    got = Counter((r["page_id"], r["url"], r["text"]) for r in op1.main_text(table).collect())
    body = "The & title\n\nOne two three\n\nFour <5> © café AB\n\na\n\nb"
    assert got == Counter({(1, "http://h.example/a/1", body): 1, (2, "http://h.example/a/2", ""): 1, (3, None, "no url"): 1, (4, "not a url", ""): 2, (None, "http://h.example/a/3", "plain text only"): 1})
    assert op1.main_text(table.where("false")).count() == 0


def plain(own):
    return f"<body><div>Menu one</div><div>Menu two</div><div>{own}</div><div>All rights</div></body>"


def test_pages_without_an_article_lose_lines_shared_with_the_nearest(spark):
    rows = [(k, f"http://s.example/{d}/p{k}", plain(f"own text number {k} of {d} with enough words to weigh more than menus")) for k, d in enumerate("aabbcc")]
    rows += [(10, "http://s.example/z/1", plain("same story told twice")), (11, "http://s.example/z/1?x=2", plain("same story told twice")), (12, "http://other.example/z", plain("alone on its host"))]
    got = {r["page_id"]: r["text"] for r in op1.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, d in enumerate("aabbcc"):
        assert got[k] == f"own text number {k} of {d} with enough words to weigh more than menus"
    assert "same story told twice" in got[10] and "same story told twice" in got[11]
    assert got[12].startswith("Menu one\n\nMenu two\n\nalone")


@pytest.mark.parametrize(
    "page,expected",
    [
        ("<div class='layout with-sidebar'><article class='post comments-open'><p>text</p></article><div class=sidebar-left>s</div></div>", ["text"]),
        ("<main><p>long enough text</p><div class=breadcrumbs>b</div></main><div>outside</div>", ["long enough text"]),
        ("<div role=main><header><h1>H</h1><p>date</p></header><p>x</div><div id=topnav>n</div>", ["H", "x"]),
        ("<article><p>main story of the page</p></article><div class=comments-area><article class=comment><p>c</p></article></div><article class='comment-1'>d</article>", ["main story of the page"]),
        ("<p>a<div class=adsbygoogle>x</div><div class='cookie-bar'>y</div><p hidden>z<svg/><p>b", ["a", "b"]),
        ("<body hidden><p>kept</p></body>", ["kept"]),
    ],
)
def test_main_text_rules(page, expected):
    from spindrift.llm.html_kernels import article

    found = blocks(page)
    assert article([b.text for b in found], [b.digest for b in found], [b.skipped for b in found], [b.root for b in found], None) == expected


def test_neighbours_equal_a_sorted_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"https://{rng.choice('ab')}.example/{rng.choice('xy')}/{rng.randrange(30)}{rng.choice(['', '/', '?q=1', '#f'])}") for k in range(120)]
    spark.createDataFrame(rows, "row long, url string").write.parquet(str(tmp_path / "p"))
    got = {r["row"]: r["partner"] for r in op1.neighbours(spark.read.parquet(str(tmp_path / "p"))).collect()}
    key = {}
    for k, u in rows:
        u = re.sub("[?#].*$", "", u)
        host, _, path = u[8:].partition("/")
        key[k] = (host, ("/" + path).rstrip("/"))

    def near(a, b):
        p, q = a.split("/"), b.split("/")
        parts = sum(p[: i + 1] == q[: i + 1] for i in range(max(len(p), len(q))) if p[: i + 1] == q[: i + 1])
        return parts, sum(a[: i + 1] == b[: i + 1] for i in range(len(a)))

    order = sorted(key, key=lambda k: (*key[k], k))
    for at, k in enumerate(order):
        beside = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order) and key[order[i]][0] == key[k][0]]
        best = max(beside, key=lambda b: (*near(key[k][1], key[b][1]), b == beside[0]))
        assert got[k] == best, (k, key[k], [key[b] for b in beside])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", ">", "<", "&", "&amp", "x y", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", '"', "'", "<br/>", "=", "\n", "<b class='ad>"]), max_size=30).map("".join))
def test_any_markup_parses(page):
    for b in blocks(page):
        assert b.text == " ".join(b.text.split()) and b.text


# --- BPE ----------------------------------------------------------------------


def test_encoding_equals_the_library_for_any_chunks(spark):
    enc = op8.tokenizer(*op8._public_tokenizer())
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "a" * 900 + " " * 700 + "b're 12345  \n\n x" * 20), (4, " " * 2000), (5, "don't we'll they're I'd " * 90), (6, "x" * 4000), (6, "x" * 4000), (None, "héé ñ 日本 " * 300), (8, "<|endoftext|> ok"), (9, "\x00\x1c   \t\r\n" * 200)]
    rows += [(10 + k, "".join(rng.choice(["a", "'", "re", " ", "  ", "\n", "1", "é", ".", "s"]) for _ in range(rng.randrange(900)))) for k in range(40)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int")
    for chunk, overlap in ((65536, 1024), (300, 40), (50, 12), (7, 9)):
        got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op8.digests(op8.decode(op8.encode(table, chunk=chunk, overlap=overlap))).collect())
        expected = Counter()
        for i, t in rows:
            ids = enc.encode_ordinary(t or "")
            expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert got == expected
    assert op8.encode(table.where("false")).count() == 0


# --- chats ----------------------------------------------------------------------


def cheapest(roles):
    """Dijkstra over (turns taken, state)."""
    import heapq

    best, heap = {(0, 0): 0}, [(0, 0, 0)]
    while heap:
        c, i, q = heapq.heappop(heap)
        if i == len(roles) and q == op9.ASSISTANT:
            return c
        if best[i, q] < c:
            continue
        steps = [(c + op9.INSERT, i, b) for b in op9.NEXT[q]]
        if i < len(roles):
            steps += [(c + op9._label_cost(roles[i], b), i + 1, b) for b in op9.NEXT[q]]
            if q:
                steps.append((c + op9.MERGE + op9._label_cost(roles[i], q), i + 1, q))
        for c2, i2, q2 in steps:
            if c2 < best.get((i2, q2), 1 << 30):
                best[i2, q2] = c2
                heapq.heappush(heap, (c2, i2, q2))
    raise AssertionError


def roles_in(text):
    return re.findall(r"<\|im_start\|>(\w+)\n", text)


def legal(names):
    state = 0
    for name in names:
        assert op9.ROLES.index(name) in op9.NEXT[state]
        state = op9.ROLES.index(name)
    return state == op9.ASSISTANT


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repairs_are_cheapest_and_legal(n):
    for roles in product(range(4), repeat=n):
        (a, b), = op9.cut_states([op9.segment_matrix(list(roles))])
        text, cost, turns, merged, relabelled, inserted = op9.render(["t"] * n, list(roles), a, b, True)
        assert cost == cheapest(roles) and legal(roles_in(text)) and turns == len(roles_in(text))
        assert turns == n - merged + inserted
        cuts = op9.cut_states([op9.segment_matrix([r]) for r in roles])
        parts = [op9.render(["t"], [r], a, b, k == n - 1) for k, (r, (a, b)) in enumerate(zip(roles, cuts))]
        assert sum(p[1] for p in parts) == cost and legal(roles_in("".join(p[0] for p in parts)))


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 5, None, None), (2, None, "Bot", "last"), (3, 1, "user", "b"), (3, 0, "user", "a<|im_end|>"), (3, 0, "user", "a<|im_end|>"), (None, 0, "user", "x"), (None, 0, "user", "x"), (4, 0, "wizard", "?")]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, segment int, cost string")
    for size in (1024, 1):
        got = {}
        for r in op9.format_chats(table, size).orderBy("segment").collect():
            got.setdefault(r["conv_id"], []).append(r)
        whole = {k: "".join(r["rendered"] for r in v) for k, v in got.items() if k is not None}
        assert whole[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
        assert whole[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nlast<|im_end|>\n"
        assert "a<| im_end|>" in whole[3]
        assert len(got[None]) == 2 and all(legal(roles_in(r["rendered"])) for r in got[None])
        assert sum(r["cost"] for r in got[4]) == op9.NAME_UNKNOWN + op9.INSERT
    assert op9.format_chats(table.where("false")).count() == 0


def test_long_conversation_is_cut_at_segments(spark):
    table = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'system' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "'t' AS text")
    rows = op9.format_chats(table, 512).orderBy("segment").collect()
    assert len(rows) == 10 and legal(roles_in("".join(r["rendered"] for r in rows)))
    roles = [1 if k % 7 == 3 else 2 if k % 2 == 0 else 3 for k in range(5000)]
    assert sum(r["cost"] for r in rows) == cheapest(roles)


# --- personal data ----------------------------------------------------------------


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))


def pii_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "1" * 30000), (4, "a" * 30000 + "@"), (5, "1-" * 20000), (6, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 001.002.3.4"), (7, "a@" + "b." * 20000), (8, "+1" + " " * 30000), (None, "x a@b.co"), (9, "é日 a@b.co 4111 1111 1111 1111."), (9, "é日 a@b.co 4111 1111 1111 1111.")]
    rows += [(100 + k, "".join(rng.choice("0123456789  --..++@@()ab_%é") for _ in range(rng.randrange(300)))) for k in range(400)]
    return rows + [(1000 + k, "4" + "".join(rng.choice("0123456789") for _ in range(15)) + " 1.2.3.4 x") for k in range(60)]


def test_base_spans_equal_plain_patterns(spark):
    rows = pii_rows()
    table = spark.createDataFrame([(*r, 3, "b") for r in rows], "doc_id long, text string, digest int, spans string")
    got = Counter((r["doc_id"], tuple(map(tuple, r["base"]))) for r in op10.find_spans(table).collect())
    assert got == Counter((i, tuple(slow_base(t))) for i, t in rows)
    assert op10.find_spans(table.where("false")).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(9)
    rows = [(k, f"filler{rng.randrange(99)} card number: {card(rng)} thanks") for k in range(12)]
    rows += [(50, "pay by card number: 4111111111111112 thanks"), (51, "order 12345678 shipped"), (52, "card number: none thanks"), (53, "see card number: 12 thanks")]
    rows += [(60 + k, f"the {card(rng) if k % 2 else 'item 99887766'} the") for k in range(10)]
    found = {r["doc_id"]: r for r in op10.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[50]["spans"]] == [(20, 2, 36)] and found[50]["base"] == []
    for i in (51, 52, 53, 60, 62):
        assert found[i]["spans"] == []
    for r in found.values():
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + d for d in "0123456789" if luhn(head + d))


def test_redaction(spark):
    rows = [(1, "mail a@b.co now +1 (017) 555-7713.", 5, "x", 0), (2, None, 0, "y", 0), (None, "q 1.2.3.4", 3, "z", 0), (4, "", 0, None, 0), (5, "clean", 99, "k", 0), (5, "clean", 99, "k", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `odd name` string, digest int")
    got = op10.redact(table)
    assert got.columns == table.columns
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == Counter({(1, "mail <EMAIL> now <PHONE>.", 25): 1, (2, None, 0): 1, (None, "q <IP>", 6): 1, (4, "", 0): 1, (5, "clean", 99): 2})


def test_personal_data_plan_is_native(spark, sf_dir):
    plan = op10.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in op1.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_lines_that_a_host_shares_go_inside_articles_too(spark):
    page = lambda k: f"<body><article><p>story {k} part one</p><p>Send this page to a friend</p></article><p>between</p><article><p>part two of {k}</p></article></body>"
    rows = [(k, f"http://t.example/n/{k}", page(k)) for k in range(10)]
    rows += [(20 + k, f"http://t.example/z/{k}", page(77)) for k in range(2)]
    got = extracted(spark, rows)
    assert got == {**{k: f"story {k} part one\n\npart two of {k}" for k in range(10)}, **{20 + k: "story 77 part one\n\npart two of 77" for k in range(2)}}


def test_short_text_in_a_large_template_stays_alone_and_copies_stay_whole(spark):
    menus = "".join(f"<div>Menu entry number {k} of the site's long template</div>" for k in range(40))
    page = lambda own: f"<body>{menus}<div>{own}</div></body>"
    told = "a story told twice " * 9
    rows = [(k, f"http://u.example/n/{k}", page(f"short {k}")) for k in range(16)]
    rows += [(30, "http://u.example/z/1", page(told)), (31, "http://u.example/z/2", page(told)), (32, "http://u.example/zz/1", page(f"{told}</div><div>seen 1")), (33, "http://u.example/zz/2", page(f"{told}</div><div>seen 2"))]
    got = extracted(spark, rows)
    assert [got[k] for k in range(16)] == [f"short {k}" for k in range(16)]
    assert all(got[k].startswith(told.strip()) and "Menu" not in got[k] for k in (30, 31, 32, 33))


def test_found_identifiers_induce_contexts(spark):
    rng = random.Random(12)
    odd = lambda: "9" + "".join(rng.choice("0123456789") for _ in range(9))
    rows = [(k, f"filler{k} card number: {card(rng)} thanks") for k in range(6)]
    bridge = [odd() for _ in range(8)]
    rows += [(100 + k, f"by card number: {x} thanks") for k, x in enumerate(bridge)]
    rows += [(200 + k, f"we billed account {x} today") for k, x in enumerate(bridge)]
    rows += [(300, f"we billed account {odd()} today"), (301, "by card number: 4111 1111 1111 1112 thanks"), (302, "in room 12345678 now")]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in op10.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[100 + k] == [(16, 2, 26)] and found[200 + k] == [(18, 2, 28)] for k in range(8))
    assert found[300] == [(18, 2, 28)] and found[301] == [(16, 2, 35)] and found[302] == []


@pytest.mark.parametrize(
    "page,expected",
    [
        ("<article><h1>T</h1><section id='search-algorithms'><p>a</p></section><p class='copyright-law'>b<p class='related-work'>c<div class='related-posts'>d</div><h2 id=notice>e</h2></article>", ["T", "a", "b", "c", "e"]),
        ("<p>a <noscript>ns</noscript> b</p><p>x<svg><text>sv</text></svg>y</p>", ["a b", "xy"]),
        ("<article><p>after <button>inline</button> text</p></article>", ["after text"]),
        ("<p>keep <iframe>f</iframe><script>s</script> this</p>", ["keep this"]),
        ("<article><p>1</p></article><article><p>2</p></article>", ["1", "2"]),
        ("<p>x<noscript><p>in</p></noscript></p>", ["x"]),
    ],
)
def test_inline_boilerplate_and_telling_names(page, expected):
    from spindrift.llm.html_kernels import article

    found = blocks(page)
    assert article([b.text for b in found], [b.digest for b in found], [b.skipped for b in found], [b.root for b in found], None) == expected


def slow_main_text(page):
    """Text of the article elements of a well-formed page of the test tables, by patterns alone."""
    import html

    out = []
    for part in re.findall(r"<article>(.*?)</article>", page or "", re.S):
        part = re.sub(r"<!--.*?-->", "", part, flags=re.S)
        for block in re.split(r"</?(?:p|h1|h2|h3|div|ul|ol|li|blockquote|section|figure|figcaption|table|tr|td)\b[^>]*>", part):
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", block))).split())
            out += [text] if text else []
    return "\n\n".join(out)


def test_whole_query_equals_patterns_on_the_small_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op1.op1_html_extraction(spark, sf_dir).collect()}
    assert got == {k: (slow_main_text(h), len(slow_main_text(h))) for k, h in pages.items()}


def test_paths_of_any_length_are_compared(spark):
    stem = "x" * 400
    rows = [(k, f"http://l.example/{stem}{name}") for k, name in enumerate(["aab", "abc", "abd"])]
    got = {r["row"]: r["partner"] for r in op1.neighbours(spark.createDataFrame(rows, "row long, url string")).collect()}
    assert got == {0: 1, 1: 2, 2: 1}


def test_contexts_hold_whole_words(spark):
    rng = random.Random(21)
    far = "w" * 300
    rows = [(k, f"{far}a number {card(rng)} {far}a. ") for k in range(6)] + [(50, f"{far}a number 9876543210 {far}b")]
    # the words before agree, so one context of the two is enough; a longer first word is another context
    rows += [(60 + k, f"{far}c card{far} {card(rng)} x") for k in range(6)] + [(70, f"{far}c dard{far} 9876543211 y")]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in op10.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for _, k, _ in found[50]] == [2] and found[70] == []


def test_shapes_come_from_seeds(spark):
    rows = [(k, f"host at {10 + k}.2.3.{k} up") for k in range(6)] + [(20, "host at 300.1.2.3 up"), (21, "host at 5.6.7 up"), (22, "host at 77 up")]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in op10.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.8).collect()}
    assert found[20] == [(8, 1, 17)] and found[21] == [(8, 1, 13)] and found[22] == []


def test_turns_without_a_conversation_are_counted(spark):
    rows = [(None, k % 3, "user", "x" if k % 2 else None) for k in range(10)] + [(None, 0, None, "x")]
    got = Counter(r["rendered"] for r in op9.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert sum(got.values()) == 11 and sorted(got.values()) == [5, 6]

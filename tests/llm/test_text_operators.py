"""Token counts, packing, language, personal data and rendering, against libraries and plain versions."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodegraph.llm import html_render, language_id, packing, pii, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n", "  a", "a  b", "a \n b\n\n", "x<|endoftext|>y <|endoftext|> z<|startoftext|>", "\ta\tb", "a b c", "don't we'll  I'M 12 345 IT'S",
    "a\r\nb", "日本語 テキスト　です", "aaaaaaaa" * 500, "é éx İstanbul. İ.", "\x1ca b​", "ΑΣ Σ ΣΑ.", "😀 😀😀", "ﬁne Ǆ ǅ", "áb", "̈ a",
    "가 각 ", "the cat  sat.\n\nOn 3.14 mats, " * 300, "!?" * 2000, "0" * 3000,
]


def texts():
    rng = random.Random(4)
    letters = "abcdeéñßäü 'ABC.,!?\n\t-<|>0123日 "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(200)]


def test_token_counts_equal_the_library(docs):
    rows = list(enumerate(texts())) + [(None, "a b"), (5, "twice"), (5, "twice")]
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = map(tuple, token_counts.token_counts(docs(rows), BYTE).collect())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_counts.token_counts(docs([]), BYTE).collect() == []


def check_packing(rows, got, window=2048):
    """Every identifier lies in exactly one piece, and every sequence is gapless."""
    library = Tokenizer.from_file(WORD)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in rows]
    wanted = sorted((str(r[0]), len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    by_doc = {}
    for x in got:
        by_doc.setdefault((x.doc_id, x.doc_tokens, x.source), []).append(x)
    unique = {(r[0], len(x), r[3]): x for r, x in zip(rows, ids)}
    for key, pieces in by_doc.items():
        whole = unique[key]
        covered = np.zeros(len(whole), int)
        for p in pieces:
            covered[p.start : p.start + p.length] += 1
            assert p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
        assert set(covered) == {sum(1 for r, x in zip(rows, ids) if (r[0], len(x), r[3]) == key)}
    assert sum(p.length for p in got) == sum(n for _, n, _ in wanted)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    return sequences


def packed_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma's", "délta", "42", "x-y"]
    rows = [(i, t, "en", "odd") for i, t in enumerate(ODD)] + [(None, "no id", "en", None), (900, "same", "en", "a"), (900, "same", "en", "a")]
    for i in range(300):
        rows.append((1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), "en", rng.choice("aaaab") + "src"))
    rows.append((5000, " ".join(rng.choice(words) for _ in range(30_000)), "en", "long"))
    return rows


@pytest.mark.parametrize("room", [4_000_000, 7_000])
def test_packing_is_whole_and_gapless(docs, room):
    rows = packed_rows()
    check_packing(rows, packing.pack(docs(rows), WORD, tokens_a_partition=room).collect())


def test_packing_keeps_to_the_proportions(docs):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(5, 400), "en", "a" if i % 4 else "b") for i in range(800)]
    got = packing.pack(docs(rows), WORD, tokens_a_partition=20_000).collect()
    share = sum(p.length for p in got if p.source == "b") / sum(p.length for p in got)
    windows = {}
    for p in got:
        own = windows.setdefault(p.sequence_id, {"a": 0, "b": 0})
        own[p.source] += p.length
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert len(full) > 50 and all(abs(w["b"] - share * 2048) <= 2 * packing.PACKET for w in full)


def test_packing_to_given_weights(docs):
    rows = [(i, "word " * 200, "en", "ab"[i % 2]) for i in range(200)]
    got = packing.pack(docs(rows), WORD, weights={"a": 3.0, "b": 1.0}).collect()
    check_packing(rows, got)
    windows = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        windows.setdefault(p.sequence_id, {"a": 0, "b": 0})[p.source] += p.length
    first = list(windows.values())[:8]
    assert all(abs(w["a"] - 0.75 * 2048) <= 2 * packing.PACKET for w in first)


def test_packing_empty_table(docs):
    assert packing.pack(docs([]), WORD).collect() == []


def test_round_robin_serves_all_and_carries_deficits():
    served = list(packing.round_robin([1000, 10, 500], [100.0, 1.0, 50.0], [0.0, 0.0, 0.0], packet=20))
    totals = [sum(n for q, n in served if q == i) for i in range(3)]
    assert totals == [1000, 10, 500]
    at = [0, 0, 0]
    for q, n in served:
        at[q] += n
        if at[0] < 900:
            assert abs(at[0] - 2 * at[2]) <= 150


# --- language --------------------------------------------------------------

SYLLABLES = {"aa": "ka ko mi tu re".split(), "bb": "sch ein ber ung ach".split(), "cc": "eau ille oux ent ion".split()}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def language_rows():
    rng = random.Random(7)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, spoken(rng, lang, rng.randint(3, 60)), lang, "s"))
    return rows


def test_language_accuracy_on_held_out_documents(docs):
    rows = language_rows()
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 34 !", "bb", "s"), (None, spoken(random.Random(1), "aa", 9), None, None), (1003, spoken(random.Random(2), "cc", 400_000), None, "s")]
    got = {r.doc_id: r for r in language_id.identify(docs(rows + odd + [rows[0]])).collect()}
    for i, text, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[None].lang_pred == "aa" and not got[None].held_out and got[1003].lang_pred == "cc"


def test_held_out_labels_are_never_learned(docs):
    rows = language_rows()
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    assert {r.lang_pred for r in language_id.identify(docs(swapped)).collect()} == set(SYLLABLES)
    assert {r.lang_pred for r in language_id.identify(docs([(1, "abc", None, "s")])).collect()} == {"und"}
    assert language_id.identify(docs([])).collect() == []


def plain_lengths(samples, text, order=language_id.ORDER):
    """Code length by walking the contexts one by one, counts taken straight from the texts."""
    pad = b"\n" * order
    out = {}
    for lang, own in samples.items():
        data = pad + pad.join(t.encode() for t in own)
        counts = {}
        for k in range(order + 1):
            for at in range(len(data) - k):
                follow = counts.setdefault(data[at : at + k], {})
                follow[data[at + k]] = follow.get(data[at + k], 0) + 1
        total, whole = 0.0, pad + text.encode()
        for at in range(order, len(whole)):
            for k in range(order, -1, -1):
                follow = counts.get(whole[at - k : at])
                if follow is None:
                    continue
                n, kinds = sum(follow.values()), len(follow)
                if whole[at] in follow:
                    total += math.log2((n + kinds) / follow[whole[at]])
                    break
                total += math.log2((n + kinds) / kinds)
            else:
                total += 8
        out[lang] = total
    return out


def test_code_lengths_equal_the_plain_trees():
    rng = random.Random(8)
    samples = {lang: [spoken(rng, lang, 30) for _ in range(4)] for lang in SYLLABLES}
    model = language_id.fit(samples)
    for text in [spoken(rng, "aa", 20), "zq xj", "schkaeau é", "a", spoken(rng, "cc", 5) + " 123"]:
        want = plain_lengths(samples, text)
        got = model.lengths(np.frombuffer(language_id.PAD + text.encode(), np.uint8)).sum(axis=0)
        assert np.allclose(got, [want[x] for x in model.languages], rtol=1e-4)


def test_every_label_is_learned(docs):
    rng = random.Random(13)
    letters = [chr(0x430 + i) for i in range(32)] + [chr(0x3B1 + i) for i in range(16)]
    rows = []
    for k in range(40):  # more labels than a list of frequent ones would hold, each with syllables of its own
        own = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)]
        rows += [(1000 * k + i, " ".join(rng.choice(own) for _ in range(40)), f"l{k:02d}", "s") for i in range(9)]
    long_ones = [(90_000 + i, spoken(rng, "bb", 7000), "long", "s") for i in range(12)]
    copies = [(95_000, "same text of a label " * 3, "hot", "s")] * 500 + [(95_001 + i, f"{spoken(rng, 'cc', 30)}", "hot", "s") for i in range(9)]
    got = {r.doc_id: r for r in language_id.identify(docs(rows + long_ones + copies)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows + long_ones if got[i].held_out]
    assert len({lang for _, lang in held}) >= 35 and all(a == b for a, b in held)
    assert any(lang == "long" for _, lang in held)


def test_text_of_no_language_goes_at_any_length(docs):
    rng = random.Random(14)
    noise = [(2000 + n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) + "q", None, "s") for n in (12, 40, 300, 20_000)]
    noise += [(3000, "плавка меди и никеля", None, "s"), (3001, "日本語の文章", None, "s")]
    kept = {r.doc_id for r in language_id.recognised(docs(language_rows() + noise)).collect()}
    assert kept == set(range(240))


def test_recognised_drops_only_rejects(docs):
    rows = language_rows() + [(1000, None, "aa", "s"), (1002, "12", "bb", "s")]
    table = docs(rows)
    kept = language_id.recognised(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(range(240))


# --- personal data ---------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(docs):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("a@.b1 2-+()x%_9é😀3.4 5\n") for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(1000 + i, "".join(rng.choice("0123456789 -.+@a") for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [
        (2000, "a@b.cd@e.fg a@b.c_d@e.fg 4111 1111 1111 1111 +1 (212) 555-1234 1.2.3.4.5.6.7.8 999.1.1.1.1.2.3"), (2001, None),
        (2002, "+1.2.3.4.5 4111111111111111-22 +1 212 555 1234"), (2003, "x" * 50_000 + " a@b.c " + "7" * 5000), (None, "mail x@y.zz"), (2004, "twice a@b.cc"), (2004, "twice a@b.cc"),
        (2005, "a@b" + ".c" * 20_000),
    ]
    got = pii.personal_data(docs(rows)).collect()
    want = []
    for i, text in rows:
        spans = plain_spans(text or "")
        named = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in spans)
        want.append((i, *[sum(k == x for _, k, _ in spans) for x in range(4)], hashlib.sha256(named.encode()).hexdigest(), named))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pii.personal_data(docs([])).collect() == []


def disclosing_rows():
    rng = random.Random(10)
    common = ["the", "report", "says", "that", "people", "were", "there", "again"]
    rows = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(12)]
        if i % 10 == 0:  # Zanzibari stands near one address only
            words[5:5] = ["Zanzibari", "wrote", "z.moss@corp.example", "and"]
        elif i % 10 == 1:
            words[5:5] = ["mail", "other.one@corp.example", "today"]
        rows.append((i, " ".join(words) + "."))
    return rows


def test_words_that_give_an_entity_away(docs):
    rows = disclosing_rows()
    got = {r.doc_id: r for r in pii.personal_data(docs(rows)).collect()}
    for i, text in rows:
        words = {text[int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x) if k == "term"}
        assert ("Zanzibari" in words) == (i % 10 == 0)
        assert not words & {"the", "report", "says", "that", "people", "were", "there", "again"}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(rows + [(500, "no data"), (501, None)])).collect()}
    assert "z.moss" not in clean[0] and "Zanzibari" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[2] == rows[2][1] and clean[500] == "no data" and clean[501] == ""


def test_one_sentence_copied_is_no_evidence(docs):
    rows = [(i, "Quillon wrote from q@corp.example yesterday") for i in range(20)] + [(100 + i, f"other text {i}") for i in range(20)]
    assert all("term" not in r.spans for r in pii.personal_data(docs(rows)).collect())


def test_words_are_found_far_from_the_entity_and_without_it(docs):
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice(["the", "report", "says", "that", "people"]) for _ in range(n))
    terms = ["Zanzibari", "O'Dell-Ray", "K9", "xq"]
    rows = [(i, filler(12)) for i in range(200)]
    for i in range(200, 206):  # all terms stand far beyond the reach of the address
        rows.append((i, f"{filler(3)} z.moss@corp.example {filler(80)} ({terms[0]}), {terms[1]} {terms[2]}; {terms[3]}. {filler(80)} {terms[0].upper()}!"))
    rows += [(300, f"Named alone: {terms[0]}, and \x01{terms[1]}."), (None, f"{terms[2]} without an id"), (301, "Zanzibaris K99 xq@else.where")]
    rows += rows[200:201]
    source = {i: t for i, t in rows}
    for r in pii.personal_data(docs(rows)).collect():
        text = source[r.doc_id]
        found = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"]
        want = [*terms, terms[0].upper()] if r.doc_id in range(200, 206) else {300: terms[:2], None: terms[2:3]}.get(r.doc_id, [])
        assert [w for w in found if w not in ("Named", "alone")] == want, r.doc_id
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(rows)).collect()}
    assert not any(t.lower() in clean[i].lower().split() for i in (*range(200, 206), 300, None) for t in terms)
    assert clean[301] == "Zanzibaris K99 [EMAIL]" and clean[0] == source[0]


# --- rendering -------------------------------------------------------------


@pytest.mark.parametrize("html, want", [
    ("", ""), ("<p>", ""), ("plain  text\n here", "plain text here"), ("<p>One<p>Two <b>bo</b>ld<br>next", "One\n\nTwo bold\nnext"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><caption>C</caption><tr><th>Name<th>n<tr><td>Apple<td>10<tr><td>Fig<br>two<td>5</table>", "C\nName  | n\nApple | 10\nFig   | 5\ntwo"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide |   | x\na    | b | c"),
    ("a<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>no</span><script>no</script><style>no</style><!-- no -->b", "ab"),
    ("<head><title>t</title></head><body>x", "x"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("<div>x<div>y</div>z</div>", "x\ny\nz"),
    ("&lt;b&gt; &amp;amp; &eacute;&#233;", "<b> &amp; éé"), ("<b>a<i>b</b>c</i>d", "abcd"), ("</p></div>x</td>", "x"), ("<img alt='a  b'> c<img>", "a b c"),
    ("<h1>T</h1><h2>U</h2>v<hr>w", "T\n\nU\n\nv\n\nw"), ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"), ("<td>a<td>b", "a\nb"), ("<", "<"), ("<p", ""),
])
def test_rendering(html, want):
    assert html_render.render(html) == want


@pytest.mark.parametrize("html, want", [
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"), ("<svg><title>no</title><defs><text>no</text></defs><text>a</text><text>b</text></svg>", "a\nb"),
    ("<textarea>\na\n  b</textarea>c", "a\n  b\nc"), ("<select><option>a<option selected>b<option>c</select>", "b"), ("<select><option disabled>a<option>b</select>", "b"),
    ("<select multiple><option>a<option label=B>c</select>", "a\nB"), ("<dialog open>yes</dialog><dialog>no</dialog>", "yes"), ("<object data=x><p>fallback</object>", "fallback"),
    ("x<input type=submit value=Send><input type=hidden value=no>", "x Send"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i>too</i></b>no</div>", "yestoo"), ("<ol style='visibility:hidden'><li>a<li style='visibility:visible'>b</ol>", "2. b"),
    ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", " | b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"), ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b | c\nd |   | e\nf |   | g"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"), ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", "a |  | b\n  |  | c"),
])
def test_what_browsers_show(html, want):
    assert html_render.render(html) == want


@pytest.mark.parametrize("seed", range(40))
def test_spans_place_cells_as_on_a_grid(seed):
    rng = random.Random(seed)
    grid, pages, n = {}, [], rng.randint(1, 6)
    for y in range(n):
        cells = []
        for k in range(rng.randint(1, 4)):
            x = next(x for x in range(99) if (x, y) not in grid)
            wide, down = rng.randint(1, 3), rng.randint(1, 3)
            if any((x + i, y) in grid for i in range(wide)):
                wide = 1
            for i in range(wide):
                for j in range(down):
                    grid.setdefault((x + i, y + j), f"{y}x{k}" if i == j == 0 else "")
            cells.append(f"<td colspan={wide} rowspan={down}>{y}x{k}")
        pages.append("<tr>" + "".join(cells))
    got = html_render.render("<table>" + "".join(pages) + "</table>").split("\n")
    for y, line in enumerate(got):
        want = [grid.get((x, y), "") for x in range(99)]
        have = [c.strip() for c in line.split("|")]
        assert have + [""] * (99 - len(have)) == want


def visible_words(html):
    """What is left when tags are simply struck out of pages without hidden parts."""
    import html as h

    return h.unescape(re.sub(r"<[^>]*>", " ", html)).split()


def test_rendering_keeps_every_visible_word(spark):
    rng = random.Random(11)
    tags = ["p", "div", "b", "li", "ul", "ol", "table", "tr", "td", "h2", "span", "pre", "th", "dd", "section"]
    rows = []
    for i in range(150):
        parts = []
        for k in range(rng.randint(1, 60)):
            parts.append(rng.choice([f" w{i}x{k} ", f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", " &amp; "]))
        rows.append((i, "".join(parts), "clash"))
    rows += [(500, None, ""), (501, "", ""), (None, "<p>x", ""), (502, "<div>" * 5000 + "deep", ""), (503, "<table><tr><td>" * 2000 + "deep", ""), (504, "<p>" + "long " * 200_000, "")]
    got = html_render.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == len(rows)
    source = {i: t for i, t, _ in rows}
    for r in got:
        words = sorted(w for w in r.text.replace("|", " ").split() if w not in ("-",) and not re.fullmatch(r"\d+\.", w))
        assert words == sorted(visible_words(source[r.page_id] or "")), r.page_id
        assert r.n_lines == (len(r.text.split("\n")) if r.text else 0) and r.n_chars == len(r.text)
    assert html_render.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []

"""Pages of HTML filings and chunks of lines against the rule followed step by step."""

import html
import random
import re
import unicodedata

from tallywise.operators import pages


def text_of(part):
    part = re.sub(r"(?is)<(script|style|ix:header)\b.*?</\1>", " ", part)
    for tags, char in ((r"(?i)</(tr|p|div|h[1-6]|li|table)>|<br\s*/?>", "\n"), (r"(?i)</t[dh]>", " "), (r"<[^>]+>", "")):
        part = re.sub(tags, char, part)
    part = html.unescape(part)
    for old, new in ((r"[ \t\xa0]+", " "), (r"\(\s+(?=\d)", "("), (r"(?<=\d)\s+\)", ")"), (r"\n\s*\n+", "\n")):
        part = re.sub(old, new, part)
    return unicodedata.normalize("NFKC", part).strip()


def one_by_one(text, limit):
    """Chunks, line after line."""
    out, line_no = [""], 0
    for line in text.split("\n"):
        if out[-1] and len(out[-1]) + len(line) > limit:
            out.append("")
        out[-1] += line + "\n"
        line_no += 1
    return out


def chunks_of(spark, texts, limit):
    got = {}
    for r in pages.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit).collect():
        got.setdefault(r.doc_id, {})[r.page] = r.text
    return [[got[k][p] for p in sorted(got[k])] for k in range(len(texts))], got


def test_chunks_are_those_of_the_sequential_rule(spark):
    r = random.Random(1)
    texts = ["", None, "\n", "\n\n\n", "a", "x" * 500, "x" * 20 + "\n" + "y" * 21, "é\U0001f600" * 30 + "\n" + "z" * 19]
    texts += ["\n".join("w" * r.choice([0, 0, 1, 5, 19, 20, 21, 60]) for _ in range(r.choice([1, 7, 60, 400]))) for _ in range(60)]
    for limit in (20, 1):
        got, by_page = chunks_of(spark, texts, limit)
        assert got == [one_by_one(t or "", limit) for t in texts]
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_page.values())
    assert pages.chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pages_of_html(spark):
    brk = '<div class="a"><p style="margin:0; page-break-before : always; color:red">'
    docs = {
        1: f"<p>one &#8217;&#x2014;&rsquo;&nbsp;&amp;lt; caf&eacute; &#150; ( 1,234 )</p>{brk}two<br/>x<BR>y{brk.upper()}( &#49;2 ) %</td><td>$</td>",
        2: f"a{brk}b",
        3: f"<ix:header>gone{brk}</ix:header>first{brk}<script>if (a < b) x();</script>{brk} \n {brk}second<hr style=\"BREAK-AFTER:page\">third<style>p</style>",
        4: None,
        5: "<span style='page-break-before:always'>single quotes don't count",
        6: "<table><tr><td>a</td><td>b</td></tr></table>" * 700,
        7: "<div style=\"x:break-before:page\"><span style=\"page-break-after:avoid\">Ⅳ ﬁ １２</span>\n \n\n</div>&copy &notit; &#0; &#x110000; &bogus; &",
    }
    found = {}
    for r in pages.html_pages(spark.createDataFrame(list(docs.items()), "doc_id long, html string")).collect():
        found.setdefault(r.doc_id, {})[r.page] = r.text
    got = {k: [v[p] for p in sorted(v)] for k, v in found.items()}
    assert got[1] == ["one ’—’ &lt; café – (1,234)", "two\nx\ny", "(12) % $"]
    assert got[2] == ["a\nb\n"] and got[4] == ["\n"] and got[5] == ["single quotes don't count\n"]
    assert got[3] == ["first", "second", "third"]
    whole = {k: re.split(pages.PAGE_BREAK, re.sub(pages.TAGGED_HEADER, " ", t or "")) for k, t in docs.items()}
    for k, parts in whole.items():
        texts = [t for t in map(text_of, parts) if t]
        assert got[k] == (texts if len(texts) > 2 else one_by_one("\n".join(texts), 6000)), k
    assert len(got[6]) == 1 and pages.html_pages(spark.createDataFrame([], "doc_id long, html string")).count() == 0

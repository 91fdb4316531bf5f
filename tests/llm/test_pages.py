"""Main text of hand-made pages, and of the given ones against their article element."""

import html
import re
from pathlib import Path

import pytest

from logweir.llm import html_extract
from logweir.llm.common import read

FOLDER = "/root/testdata/sf0.01"
PAGES = {
    "no article": (
        '<html><head><title>t</title></head><body><div id="header"><a href=x>Start</a> <a>Help</a></div><div id="content"><h2>On ferries</h2>'
        "<div>The ferry leaves when the tide is in, and never before.</div><div>Ask <i>the captain</i> or <a href=u>the mate</a> about it.</div>"
        '<ul><li>bring a coat</li><li>and tea</li></ul></div><div id="footer">All rights reserved by nobody</div></body></html>',
        "On ferries The ferry leaves when the tide is in, and never before. Ask the captain or the mate about it. bring a coat and tea",
    ),
    "reader comments": (
        "<body><main><p>The ferry leaves when the tide is in, and never before.</p></main><div class='comments'><h3>2 voices</h3>"
        "<p>I missed it last year and waited for a whole day on the pier</p><p>so did I, and it rained</p></div></body>",
        "The ferry leaves when the tide is in, and never before.",
    ),
    "notices inside": (
        '<article><p>One boat left.</p><div class="cookie-banner"><p>We bake cookies, fine?</p></div><p>Two came back.</p>'
        "<aside>More about boats</aside><form><label>Mail</label><button>Send</button></form><p>Three stayed.</p></article>",
        "One boat left. Two came back. Three stayed.",
    ),
    "references": ("<article><p>a&nbsp;b &#8212; c &lt;tag&gt; &amp;amp; d&hellip;</p></article>", "a b — c <tag> &amp; d…"),
    "scripts": (
        '<article><p>Hello pier</p><script>if(a<b){document.write("<p>x</p>")}</script><style>p{}</style><!-- <p>no</p> --><p>bye now</p></article>',
        "Hello pier bye now",
    ),
    "unclosed": ("<body><nav><a>x</a></nav><article><p>Para one words<p>Para two <b>wor</b>ds", "Para one words Para two words"),
    "blocks": ("<article><pre>x = 1\n y = 2</pre><table><tr><td>a</td><td>b</td></tr></table>c<br>d</article>", "x = 1 y = 2 a b c d"),
    "no markup": (" plain \t words ", "plain words"),
    "nothing": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, expected = PAGES[name]
    assert html_extract.extract_text(page, {}) == expected


def test_best_run():
    assert html_extract._best([1, -2, 3, -1, 3, -9, 4]) == (2, 5)
    assert html_extract._best([-1, -1]) == (0, 0) and html_extract._best([]) == (0, 0)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
def test_given_pages(spark):
    pages = read(spark, FOLDER, "pages")
    source = {row.page_id: row.html for row in pages.collect()}
    for row in html_extract.extract(pages).collect():
        article = re.search("<article>(.*?)</article>", source[row.page_id], re.DOTALL)[1]
        flat = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))
        assert row.text == " ".join(html.unescape(flat).split())

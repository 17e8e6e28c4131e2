from __future__ import annotations

import pytest

from sagebase.operators.html import to_markdown


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("<body><p>a</p><template>x</template><canvas>y</canvas><input value=z>b</body>", "a\nb"),
        ("<div class=memitem>x</div><div id=top>y</div><p class='tabs one'>z</p><p>kept</p>", "kept"),
        ("<header>gone</header><header class=header>kept</header>", "kept"),
        ("<div class=header><div class=title>Class A</div></div><div class=contents><p>text</p></div><p>out</p>", "# Class A\ntext"),
        ("<div class=contents> </div><article>main <b>text</b></article>", "main text"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "| 1 | 2 |"),
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("<ol><li>one<ul><li>two</li></ul></li><li>three</li></ol>", "1. one\n- two\n1. three"),
        ("a<img alt=' pic '>b", "a\n[图片: pic]\nb"),
        ("<h2>Head <i>line</i></h2>text<br>more", "## Head line\ntext\nmore"),
        ("<pre>\n  x = 1\n    y\n</pre>", "```\nx = 1\n    y\n```"),
        ("<p>a&nbsp; b\n c</p><div class=searchbox>s</div><section>d</section>", "a b c\nd"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\ntwo\n- x\n- y"),
        ("<title>t</title><script>s</script>plain", "plain"),
    ],
)
def test_pages(html, want):
    assert to_markdown(html) == want

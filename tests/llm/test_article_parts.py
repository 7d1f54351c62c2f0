"""What belongs to an article although its name or tag stands for its surroundings elsewhere."""

import pytest

from auditloom.llm.html_extract import page_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><svg viewBox='0 0 1 1'/><p>one</p></article><p>out", "one"),
        ("<article><svg><path d='x'/></svg><p>one</p></article>", "one"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>one</p></article>", "Title\none"),
        ("<body><form action=x><nav>menu</nav><article><p>one</p></article><input></form></body>", "one"),
        ("<body><form action=x><h1>Title</h1><p>one</p></form><footer>f</footer></body>", "Title\none"),
        ("<body><form><p>Your name</p></form><p>one</p></body>", "one"),
        ("<article><p>one</p><form>name</form><section id='search'><p>on search</p></section><div class='related-posts'>no</div><div class=comments>no</div></article>", "one\non search"),
        ("<article><nav>menu</nav><aside>side</aside><p>one</p></article>", "one"),
    ],
)
def test_parts(page, want):
    assert page_text(page) == want

"""Pages with more open tags than any fixed depth."""

import pytest

from auditloom.llm.html_extract import page_text

MANY = 500


@pytest.mark.parametrize("open_tags", ["<p>x", "<p><b>x", "<font>x ", "<b>x "])
def test_parts_behind_many_unclosed_tags_are_dropped(open_tags):
    page = "<div><article>" + open_tags * MANY + "<nav>menu</nav><div class=ad>buy</div><aside>side</aside><div>inner</div><p>tail</p></article></div>"
    text = page_text(page)
    assert "menu" not in text and "buy" not in text and "side" not in text
    assert text.count("x") == MANY and text.endswith("inner\ntail")


def test_a_block_start_closes_a_p_but_not_beyond_a_button_or_a_cell():
    assert page_text("<p class=ad>buy<div>text</div>") == "text"
    assert page_text("<table><tr><td class=ad><p>buy<div>more</div></td><td>cell</td></tr></table>") == "cell"
    assert page_text("<p>a<b class=ad>buy<p>buy too</b>b") == "a\nb"

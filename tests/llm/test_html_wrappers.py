import pytest

from fairlane.llm import html_text

BODY = "<h1>Head</h1>" + "<p>Some long text, with commas, and more of it.</p>" * 6
TEXT = "Head " + " ".join(["Some long text, with commas, and more of it."] * 6)
AROUND = ('<div class="menu"><a href=x>Home</a> <a href=y>More</a></div>', '<div class="sidebar"><p>Read this, too. And that.</p></div><footer>Made by us, really.</footer>')


@pytest.mark.parametrize("start, end", [
    ("<form action=x>", "</form>"), ('<form id="aspnetForm">', "</form>"), ('<div class="with-sidebar">', "</div>"), ('<div id="has-menu">', "</div>"),
    ('<div class="social-page legal">', "</div>"), ('<form><div class="with-sidebar">', "</div></form>"), ('<form><fieldset class="search comments">', "</fieldset></form>"),
    ('<form><article>', "</article></form>")])
def test_marked_elements_around_the_whole_page_are_no_loss(start, end):
    assert html_text.main_text(f"<body>{start}{AROUND[0]}<div class=text>{BODY}</div>{AROUND[1]}{end}</body>") == TEXT
    assert html_text.main_text(f"<body>{AROUND[0]}{start}<div class=text>{BODY}</div>{end}{AROUND[1]}</body>") == TEXT


def test_long_comments_and_hidden_parts_still_go():
    comments = "<section id=comments><p>" + "Nice post, really great. " * 60 + "</p></section>"
    for page in (f"<body><article>{BODY}</article>{comments}</body>", f"<body><article>{BODY}{comments}</article></body>", f"<body><form><article>{BODY}</article>{comments}</form></body>"):
        assert html_text.main_text(page) == TEXT
    assert html_text.main_text(f"<body><form hidden>{BODY}</form></body>") == ""

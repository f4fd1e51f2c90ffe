"""Inside the article nothing goes but what all of its marks call something else."""

import pytest

from fairlane.llm import html_text

PLAIN = "Some long text, with commas, and more of it."
BODY = f"<p>{PLAIN}</p>" * 4


@pytest.mark.parametrize("inside, text", [
    ('<p id="search">How we searched, in short.</p>', "How we searched, in short."),
    ('<p class="share-price">The share price fell, again.</p>', "The share price fell, again."),
    ('<section class="discussion"><p>What it means, we think.</p></section>', "What it means, we think."),
    ('<div class="cookie-recipe"><p>Flour, butter, sugar.</p></div>', "Flour, butter, sugar."),
    ("<ul><li><a href=a>One book</a></li><li><a href=b>Two books</a></li><li><a href=c>Three books</a></li></ul>", "One book Two books Three books"),
    ('<h2 class="notice">To be noticed</h2>', "To be noticed"),
    ('<div class="legal-history"><p>The law, from 1900 on.</p></div>', "The law, from 1900 on."),
])
def test_parts_of_the_article_stay(inside, text):
    want = " ".join([PLAIN] * 4 + [text] + [PLAIN] * 4)
    for page in (f"<body><article>{BODY}{inside}{BODY}</article></body>", f"<body><nav>x</nav><main><div>{BODY}{inside}{BODY}</div></main></body>"):
        assert html_text.main_text(page) == want


@pytest.mark.parametrize("inside", [
    '<div class="share-buttons"><a href=x>Share</a></div>', '<div id="comments" class="comments-area"><p>Nice post, really great.</p></div>',
    '<p class="advert">Buy now, cheaply.</p>', '<div class="ad-slot"><p>Buy now, cheaply.</p></div>', '<div class="cookie-notice"><p>We use cookies.</p></div>',
    '<section class="related-posts"><p>Read this, too.</p></section>', '<div class="newsletter-signup"><p>Subscribe, now.</p></div>',
    '<ol class="comment-list"><li>Great, thanks.</li></ol>', "<nav><ul><li><a href=a>Part</a></li></ul></nav>", "<form><p>Your mail, please.</p></form>"])
def test_what_is_marked_as_something_else_goes(inside):
    assert html_text.main_text(f"<body><article>{BODY}{inside}{BODY}</article></body>") == " ".join([PLAIN] * 8)

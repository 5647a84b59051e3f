import pytest

from textgate.llm.html_text import candidates


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content-sidebar-wrap"><main><p>Body</p></main></div>', "Body"),
        ('<div class="content-sidebar-wrap"><article><p>Body</p></article><div class="sidebar">No</div></div>', "Body"),
        ('<div class="sidebar-left"><article><p>Body</p></article></div>', "Body"),
        ('<article class="post has-comments"><p>Body</p><div class="comments"><article class="comment">No</article></div></article>', "Body"),
        ('<main><p>Body</p><section class="related-posts"><article>No</article></section></main>', "Body"),
        ('<article><p>Body</p><div><svg><path d=1></div><p>more</p></article>', "Body more"),
        ('<article><p>Body</p><div><object>No</div><p>more</p></article>', "Body more"),
        ('<article><p>Let <math><mi>x</mi><annotation>x</annotation></math> be</p></article>', "Let x be"),
        ('<article><p>Body</p><script>no <p>no</p></article>', "Body"),
        ('<div hidden><main>No</main></div><p>Body</p>', "Body"),
        ('<div class="comments"><article class="comment">No</article></div>', ""),
    ],
)
def test_roles(page, text):
    assert " ".join(t for _, t, _ in candidates(page)) == text

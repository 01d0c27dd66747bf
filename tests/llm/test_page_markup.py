"""Op 5: markup that must not take article text with it."""

import pytest

from folioflow.llm import pages

ARTICLE = "<article><p>First words.</p><p>Last words.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<body><script>for(i=0;i<n;i++){f(i)}</script>",
        "<head><script>if(a<b && c){d('</p>')}</script></head><body>",
        "<body><SCRIPT>x<y</Script ><style>a>b{c:'<d'}</style>",
        "<head><title>A <b> title</title><meta charset=utf-8><body>",
        "<head><title>A title</title><link rel=x><noscript><img src=x></noscript>",
        "<html><head><template><p>no</p></template><style>p{}</style>",
        "<body><noscript><p>a<b</noscript><svg><title>i</title><style>a<b</style></svg>",
    ],
)
def test_article_stays(before):
    for page in (before + ARTICLE, before + ARTICLE + "<script>a<b</script>"):
        assert [b.text for b in pages.leaf_blocks(page)] == ["First words.", "Last words."]


def test_text_ends_a_head():
    assert [b.text for b in pages.leaf_blocks("<head><title>t</title>Plain text")] == ["Plain text"]
    assert pages.leaf_blocks("<head><title>t</title></head><script>x<y") == []


def test_formulas_stay():
    page = "<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>x{=}1</annotation></semantics></math> holds.</p>"
    assert [b.text for b in pages.leaf_blocks(page)] == ["So x=1 holds."]

import pytest

from tessera.llm import html_blocks


@pytest.mark.parametrize(
    "before",
    [
        "<svg width=1 />", "<math/>", "<SVG/>", "<object data=x>", "<noscript>", "<template>", "<iframe src=x>", "<style>", "<svg><path/>", "<svg><path d=1>no</path></svg>", "<svg>no<svg/>no<svg>no</svg>no</svg>",
        "<object>no<object>no</object>no</object>", "<noscript>no</noscript>", "<script>no</script>",
    ],
)
@pytest.mark.parametrize("after", ["", "<svg>no</svg><math>no</math><object>no</object><noscript>no</noscript><template>no</template>"])
def test_text_behind_an_element_without_an_end_is_read(before, after):
    page = f"<html><body><p>one</p>{before}<article><p>two</p></article>{after}<p>three</p></body></html>"
    assert [b.text for b in html_blocks.blocks(page)] == ["one", "two", "three"]


def test_a_script_cut_off_and_many_elements_without_an_end():
    assert [b.text for b in html_blocks.blocks("<p>one</p><script>if (a) { two")] == ["one"]
    assert [b.text for b in html_blocks.blocks("<object><iframe>" * 100_000 + "<p>one</p>")] == ["one"]

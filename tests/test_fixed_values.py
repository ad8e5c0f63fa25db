"""The fixed values that results hang on, written out once more by hand: the oracles take them from the package."""

from sparkcurate.config import SIMPLE_SPLIT, SplitRatios
from sparkcurate.functions import tags, text
from sparkcurate.operators import events, graph

# Fixed values.
ENGLISH = "the of and in for is to a an with from by on are was that this"
KEYWORD_STOPS = (
    "a an the and or but in on at to for of with by from is it as be was are were been being have has had do does did "
    "will would could should may might shall can this that these those not no its we our their using based via into "
    "over about between through during before after above below up down than other such only also more most very each "
    "every all both few many some any new first two one which when how what"
)
QUERY_STOPS = (
    "what which how why when where who whom is are was were be been being have has had do does did will would could "
    "should the a an and or but in on at to for of with by from as into through during this that these those it its "
    "can may might explain describe define discuss compare contrast give provide list name identify answer question "
    "following example examples please briefly detail given assume using use find denotes all pairs sum sigma beta "
    "left right frac text"
)
COLORS = "#7eb8ff #6ee7d8 #ffd666 #c084fc #ff7eb3 #a3e635 #fb923c #60a5fa #f472b6 #34d399"


def test_words():
    assert sorted(text.ENGLISH_WORDS) == sorted(ENGLISH.split())
    assert sorted(text.KEYWORD_STOP_WORDS) == sorted(KEYWORD_STOPS.split())
    assert sorted(text.QUERY_STOP_WORDS) == sorted(QUERY_STOPS.split())


def test_white_space_is_what_a_string_is_stripped_of():
    assert sorted(text.WHITESPACE) == [chr(c) for c in range(0x110000) if not chr(c).strip()]


def test_spaces_in_patterns():
    assert text.with_spaces(r"a\s[,\s]\[\s") == rf"a[{text._SPACES}][,{text._SPACES}]\[[{text._SPACES}]"


def test_numbers_and_names():
    assert list(graph.CLUSTER_COLORS) == COLORS.split() and graph.ORPHAN_COLOR == "#888888"
    assert graph.DRAWN == graph.GraphLimits(qa_nodes=150, qa_per_paper=2, qa_per_dataset=4, edge_papers=200)
    assert set(events.TERMINAL) == {"completed", "failed", "cancelled"}
    assert SplitRatios() == SplitRatios(0.6, 0.2, 0.2, 3407) and (SIMPLE_SPLIT.train, SIMPLE_SPLIT.val) == (0.8, 0.1)
    assert tags.MISSING_TEXTS["</answer>"] == "Missing </answer> tag - CRITICAL: model learned to never conclude"

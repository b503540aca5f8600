import re
from html.parser import HTMLParser

from passagemill.plans import views as v
from passagemill.plans.catalog import QUERIES
from passagemill.sources.html import CONTENT, LINE_ENDS, NO_END, NOISE, SKIPPED

SF = "/root/testdata/sf0.001"


def test_matrix_equals_each_setting_alone(spark):
    """Shared channels give what every setting gives when it is run by itself."""
    c, index = v.default_index(spark, SF)
    asked, rules = v.questions(spark, SF), v.rules(spark)
    got = {}
    for r in v.retrieve_all(asked, c, index, rules).collect():
        got.setdefault(r.config, set()).add((r.query_id, r.chunk_id, r.rank, round(r.score, 9)))
    for name, mode, how, rerank, rewrite in v.CONFIGS:
        alone = v.retrieve(asked, c, index, mode, how, rerank, rules if rewrite else None).collect()
        assert got[name] == {(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in alone}, name
    assert len(got) == 11 and {r.config for r in QUERIES["experiment_matrix"](spark, SF).collect()} == set(got)


class Tree(HTMLParser):
    """The whole element tree: (tag, attributes, children), text as strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(reversed(attrs)), [])
        self.open[-1][2].append(node)
        if tag not in NO_END:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append((tag, dict(reversed(attrs)), []))

    def handle_endtag(self, tag):
        if len(self.open) > 1 and tag not in NO_END:
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_text(node):
    tag, attrs, children = node
    words = lambda m: set(re.findall("[a-z0-9]+", m))
    marks = [(attrs.get(a) or "").lower() for a in ("class", "id", "role", "aria-label")]
    if tag in SKIPPED or any(any(n in m for n in NOISE) and not words(m) & CONTENT for m in marks):
        return ""
    inner = "".join(c if isinstance(c, str) else plain_text(c) for c in children)
    return f"\n{inner}\n" if tag in LINE_ENDS else inner


def test_pages_against_a_tree(spark, tmp_path):
    """Every given page with well nested elements: the same lines as from a tree of the whole page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    made = [("<div class='main-nav content'>kept</div><div id=navbar>gone<p>too</p></div><p>a<br>b</p>", ["kept", "a", "b"])]
    from passagemill.sources.html import extract

    rows = spark.createDataFrame([(r.page_id, r.html) for r in pages] + [(-1, made[0][0])], "page_id long, html string")
    got = {r.page_id: r.text.split("\n") if r.text else [] for r in extract(rows).collect()}
    assert got[-1] == made[0][1]
    for r in pages:
        t = Tree()
        t.feed(r.html or "")
        t.close()
        lines = [re.sub(r"[ \t　\xa0]+", " ", x).strip() for x in plain_text(t.root).split("\n")]
        want = [x for x in lines if x and not (len(x) <= 40 and re.fullmatch(r"[×✕✖xX]|[0-9a-fA-F]{16,}|[A-Za-z0-9+/=]{24,}", x))]
        assert got[r.page_id] == want, r.page_id


def test_long_chains_and_circles(spark):
    from passagemill.operators.telemetry import span_depths

    rows = [("t", str(i), str(i - 1) if i else None) for i in range(300)] + [("u", "a", "b"), ("u", "b", "a"), ("u", "c", "gone"), ("u", "d", "c")]
    got = {(r.trace_id, r.span_id): r.depth for r in span_depths(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")).collect()}
    assert got == {("t", str(i)): i + 1 for i in range(300)} | {("u", "a"): 1, ("u", "b"): 1, ("u", "c"): 1, ("u", "d"): 2}


def test_random_draw_of_many_targets(spark):
    from passagemill.operators.evaluation import random_draw

    d = spark.createDataFrame([("all", [1] * 40, 100), ("all", [1, 0], 10), ("any", [1] * 40, 100), ("all", [1], 3)], "mode string, counts array<bigint>, total bigint")
    got = [r.hit for r in random_draw(d, 5).collect()]
    assert abs(got[0]) < 1e-6 and got[1] == 0 and 0.9 < got[2] < 1 and got[3] == 0

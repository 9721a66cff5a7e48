"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from snaptext.checks.bindings import CURRENT, data
from snaptext.checks.queries import registered
from snaptext.operators import lexical, timelines


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_cross_joins(spark, name):
    text = plan(registered()[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.fixture(scope="module")
def d(spark):
    return data(spark, SMALL)


def test_scores_meet_without_a_shuffle(spark, d):
    """Blocks are bucketed by parts of the chunks: after the join the only exchanges are broadcasts."""
    terms = lexical.query_terms(d.asked, {})
    text = plan(lexical.scores(d.search_tables.index, terms))
    after_join = text.split("\n\n")[0].split("BroadcastHashJoin")[0]
    assert "HashAggregate" in after_join
    assert not re.search(r"(?<!Broadcast)Exchange", after_join)
    assert "Bucketed: true" in text


def test_top_lists_are_cut_before_the_shuffle(spark, d):
    assert "WindowGroupLimit" in plan(lexical.lexical_hits(d.search_tables.index, d.asked))


def test_scans_read_only_what_is_used(spark, d):
    text = plan(registered()["fetch_snapshot"](spark, SMALL))
    scan = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "title" not in scan and "section" not in scan and "text" not in scan
    assert "EqualTo(snapshot" in text
    orders = plan(timelines.build_timeline(d.order_changes()))
    assert "o_totalprice" not in orders


def test_as_of_shuffles_each_side_once(spark, d):
    """Segments and probes meet in one window per entity, not in a join."""
    line = d.turn_timeline()
    text = plan(timelines.as_of(line, d.turns().select("entity_id", F.current_date().alias("as_of"))))
    assert "Union" in text and "NestedLoop" not in text


def test_index_holds_the_current_snapshot_only(spark, d):
    now = d.chunks.where(F.col("snapshot") == CURRENT).count()
    assert d.search_tables.index.n_chunks == now


def test_neighbours_meet_their_lists_without_shuffling_the_index(spark, d):
    from snaptext.operators import neighbours

    index = d.unit_vectors
    asked = neighbours._coded(neighbours._prepared(d.vector_queries(), ["query_id", "sub_no"], True), index.scale)
    text = plan(neighbours.candidates(asked, index, 10, 0.5))
    assert "Bucketed: true" in text and "CartesianProduct" not in text
    assert "vector" not in re.search(r"ReadSchema: (struct<[^\n]*code[^\n]*)", text).group(1)

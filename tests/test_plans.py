"""Plan checks: what the physical plans may and may not contain."""

import re

import pytest

from foldwise.operators import monitor as R
from foldwise.plans.checks import exchanges, plan_text, python_row_udfs
from foldwise.plans.registry import load
from foldwise.plans import tables as T
from tests.conftest import SF01

QUERIES, _ = load()
SF001 = "/root/testdata/sf0.001"
# builds a stream and runs it; its plan is a plain parquet read
SKIP = {"r4_early_stop_stream"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_row_at_a_time_python(spark, name):
    assert python_row_udfs(QUERIES[name](spark, SF001)) == 0


@pytest.mark.parametrize("name", ["t9_t10_word_starts", "t11_align_labels", "t12_scatter_target",
                                  "t11_t12_soft_target", "t2_pad", "t3_specials"])
def test_text_operators_do_not_shuffle(spark, name):
    assert exchanges(QUERIES[name](spark, SF01)) == []


def test_delta_early_stop_groups_are_buckets(spark):
    log = T.loss_log(spark, SF01)
    txt = plan_text(R.early_stop(log, 4, delta=0.01, bucket_rows=64), "simple")
    groups = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", txt)
    assert groups, txt
    # every Python group is a bucket (or a group of bucket summaries) of a run, never a whole run
    assert all(re.search(r"_bk|_g", g) for g in groups), groups

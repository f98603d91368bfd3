"""Queries whose database is in the memory of one process stop on a cluster, instead of reading an empty database on each executor."""

from types import SimpleNamespace

import pytest

from loomwright import queries_jobs
from loomwright.registry import QUERIES


def session(master):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn"])
@pytest.mark.parametrize("name", ["e8_write_jdbc", "s1_scan_table", "s4_scan_catalog"])
def test_a_cluster_is_refused(name, master):
    with pytest.raises(RuntimeError, match="in the memory of"):
        QUERIES[name](session(master), "/nowhere")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*,2]"])
def test_one_process_is_taken(master):
    queries_jobs._local(session(master))

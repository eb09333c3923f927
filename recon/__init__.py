"""Compare tables and judge data quality on Spark."""

from recon.functions.names import Remapping
from recon.functions.predicates import CompareRules
from recon.operators.hashdiff import bisect_report, hash_diff, rowset_diff
from recon.operators.joindiff import Compared, compare_by_key, join_diff
from recon.plans.batch import batch_compare
from recon.plans.compare import ComparisonResult, Options, compare
from recon.plans.release import release_diff
from recon.session import build_session
from recon.sources.readers import connect_to_table, read_files, read_jdbc, read_query, read_table
from recon.sources.side import TableSide, side
from recon.sources.store import ResultStore

__all__ = [
    "Compared",
    "CompareRules",
    "ComparisonResult",
    "Options",
    "Remapping",
    "ResultStore",
    "TableSide",
    "batch_compare",
    "bisect_report",
    "build_session",
    "compare",
    "compare_by_key",
    "connect_to_table",
    "hash_diff",
    "join_diff",
    "read_files",
    "read_jdbc",
    "read_query",
    "read_table",
    "release_diff",
    "rowset_diff",
    "side",
]

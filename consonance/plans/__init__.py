"""Composed analyses and the named query catalog.

Importing this package registers every query in ``registry.REGISTRY``.
"""

from . import similarity_reports  # noqa: F401
from . import variance_reports  # noqa: F401
from . import task_reports  # noqa: F401
from . import attempt_reports  # noqa: F401
from . import text_reports  # noqa: F401
from . import cluster_reports  # noqa: F401
from . import io_reports  # noqa: F401
from . import inference_reports  # noqa: F401
from . import stream_reports  # noqa: F401
from . import replay_reports  # noqa: F401
from . import branch_reports  # noqa: F401
from .registry import REGISTRY  # noqa: F401

"""Imports every plan module so that its queries register."""

from . import q_reports  # noqa: F401
from . import q_clean  # noqa: F401
from . import q_books  # noqa: F401
from . import q_series  # noqa: F401
from . import q_forecast  # noqa: F401
from . import q_models  # noqa: F401
from . import q_snapshots  # noqa: F401

"""Column -> Column expressions.  All run inside Catalyst (no Python workers)."""

from calltrail.functions.render import *  # noqa: F401,F403
from calltrail.functions.masking import *  # noqa: F401,F403

from kpiloom.functions.exprs import *  # noqa: F401,F403
from kpiloom.functions.windows import *  # noqa: F401,F403

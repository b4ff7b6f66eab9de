from . import association, cleaning, evaluation, modelling, profiles, shaping, sources  # noqa: F401  (register queries)
from .registry import oracles, registered

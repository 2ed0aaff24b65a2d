"""The query catalogue."""

from . import catalogue as catalogue
from . import methods as methods

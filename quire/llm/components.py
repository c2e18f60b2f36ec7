"""Another name of :mod:`quire.components`."""

import sys

from quire import components

sys.modules[__name__] = components

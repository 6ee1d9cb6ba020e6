"""``python -m chunkmere``: the command line."""

import sys

from chunkmere.cli import main

sys.exit(main())

"""``python -m rollcall ...`` runs the daily loads (see ``rollcall.daily``)."""

import sys

from rollcall.daily import main

sys.exit(main())

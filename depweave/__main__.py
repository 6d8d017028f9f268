import sys

from depweave.cli import main

sys.exit(main())

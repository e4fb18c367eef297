import sys

from ferrule.cli import main

sys.exit(main())

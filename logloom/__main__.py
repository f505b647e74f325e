import sys

from logloom.cli import main

sys.exit(main())

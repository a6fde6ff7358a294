import sys

from molspan.cli import main

sys.exit(main())

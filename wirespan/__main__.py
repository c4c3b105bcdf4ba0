import sys

from wirespan.cli import main

sys.exit(main())

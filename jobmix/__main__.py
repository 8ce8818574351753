import sys

from jobmix.cli import main

sys.exit(main())

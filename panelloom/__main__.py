import sys

from panelloom.cli import main

sys.exit(main())

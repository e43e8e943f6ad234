import sys

from weftline.cli import main

sys.exit(main())

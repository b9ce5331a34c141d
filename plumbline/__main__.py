"""python -m plumbline COMMAND"""

from plumbline.cli import main

raise SystemExit(main())

from polyscan.cli import main

raise SystemExit(main())

from .service.command import main

raise SystemExit(main())

mysql: [Warning] Using a password on the command line interface can be insecure.
Table	Create Table
shop_daily	CREATE TABLE "shop_daily" (\n  "day" date NOT NULL,\n  "game_id" char(32) NOT NULL,\n  "plays" int unsigned DEFAULT NULL,\n  "stake" decimal DEFAULT NULL,\n  PRIMARY KEY ("day","game_id")\n)

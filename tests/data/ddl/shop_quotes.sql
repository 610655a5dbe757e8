Table	Create Table
shop_quotes	CREATE TABLE "shop_quotes" (\n  "id" int NOT NULL,\n  "note" varchar(40) DEFAULT \'it\',\n  "empty" varchar(4) DEFAULT '',\n  "rate" float DEFAULT 1.5,\n  PRIMARY KEY ("id")\n)

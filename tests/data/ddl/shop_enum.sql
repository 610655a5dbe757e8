Table	Create Table
shop_enum	CREATE TABLE "shop_enum" (\n  "id" smallint unsigned NOT NULL,\n  "kind" enum('a','b,c') DEFAULT 'a',\n  "flags" set('x','y') DEFAULT NULL,\n  "made" year DEFAULT NULL,\n  "opens" time(6) DEFAULT NULL,\n  PRIMARY KEY ("id")\n)

"""talkloom.streaming"""
